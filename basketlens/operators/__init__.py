"""Reusable relational building blocks (facts, sequences, quantiles, band joins)."""
