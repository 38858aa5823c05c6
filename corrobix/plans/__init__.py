"""Composite queries and the SQL they are checked with."""
