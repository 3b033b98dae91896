"""Operators for preparing training data, one module each, with the queries that apply them."""
