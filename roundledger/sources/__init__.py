"""Reading, loading, evolving and writing tables."""
