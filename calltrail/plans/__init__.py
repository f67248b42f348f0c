"""Registered queries: the operators over the given tables, each with its SQL check."""
