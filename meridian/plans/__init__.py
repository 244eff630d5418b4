"""Queries over the tables, and their SQL."""
