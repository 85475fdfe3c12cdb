"""Queries over the driver's tables, by family."""
