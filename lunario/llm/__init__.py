"""Operators of a training-data pipeline, one module each; see ``queries`` for the registered ones."""
