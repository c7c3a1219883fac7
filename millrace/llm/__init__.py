"""Operators for preparing training text, their queries and the SQL of those queries."""
