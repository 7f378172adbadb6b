"""Graph patterns, the graph store and round-based plans."""
