"""Composed retrieval plans and the registry of queries."""
