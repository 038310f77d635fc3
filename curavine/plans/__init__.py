"""Registered queries and whole pipelines."""
