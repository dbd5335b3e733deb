"""Check queries: each runs an operator on the test tables and has the same result in SQL."""
