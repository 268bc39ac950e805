"""Derived tables the queries run on."""
