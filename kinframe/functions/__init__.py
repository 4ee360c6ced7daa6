"""Predicates, scalar functions and JSON columns: everything that gives a Column."""
