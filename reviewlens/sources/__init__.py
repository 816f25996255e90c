"""Reading, writing and serving tables."""
