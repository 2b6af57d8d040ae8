"""The driver's catalog of queries."""
