"""Composed plans: the query registry, report tables and the SQL oracle."""
