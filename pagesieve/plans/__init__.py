"""Plans: the registered queries and their oracles."""
