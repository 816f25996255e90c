"""DataFrame operators: profiling, sampling, deduplication, enrichment, sentiment."""
