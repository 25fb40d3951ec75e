"""DataFrame -> DataFrame operators: lookups, ranking, search, sampling, vectors, losses, metrics."""
