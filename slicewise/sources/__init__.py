"""Readers and writers for headers, labels, documents, tables and logs."""
