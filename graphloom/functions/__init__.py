"""Column functions and name handling."""
