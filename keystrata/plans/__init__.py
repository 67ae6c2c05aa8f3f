"""Registered queries: each operator over the test tables, with SQL of the same result."""
