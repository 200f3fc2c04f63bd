"""Registered queries, one module for each group of operators."""
