"""Counted tables, split tables and result files."""
