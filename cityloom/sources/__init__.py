"""Readers and derived layers."""
