"""Queries over the tables of the test data, and SQL to compare them with."""
