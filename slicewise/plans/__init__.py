"""Composed flows, the input mappings of the test tables and the query registry."""
