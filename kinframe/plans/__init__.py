"""Queries over the driver's tables, one or more for each operator, with their SQL."""
