"""Readers and writers for files that Spark has no format for."""
