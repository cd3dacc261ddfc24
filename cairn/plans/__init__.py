"""Query grammar, the registry of queries, and their SQL."""
