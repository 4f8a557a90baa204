"""Registered queries, one module per group of operators."""
