"""Pipelines over the operators, and the queries that show them."""
