"""Column functions: text keys, guarded arithmetic, rules."""
