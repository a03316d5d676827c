"""Query plans: storing intermediate results, and the catalogue of queries with their SQL."""
