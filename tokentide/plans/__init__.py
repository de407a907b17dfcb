"""Whole jobs, and the registered queries over the given tables with their SQL."""
