"""DataFrame operators: listings, resolution, graph queries."""
