"""Analytical queries and pipelines composed from the operators."""
