"""Composed plans and the registry of checked queries."""
