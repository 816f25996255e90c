"""Column expressions: text standardisation and exact numeric helpers."""
