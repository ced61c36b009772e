"""DataFrame operators for metadata, encoding, marginals, statistics, evaluation and synthesis."""
