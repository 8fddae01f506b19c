"""Operators for preparing large text corpora for model training.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface and the thin ``opN_<name>`` query that applies
it to the standard tables; ``registry`` lists the queries and their SQL.
"""
