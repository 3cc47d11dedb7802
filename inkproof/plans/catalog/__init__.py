"""The registered queries, by family."""
