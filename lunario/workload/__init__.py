"""Queries over the test tables: base tables derived from them, one query per operator."""
