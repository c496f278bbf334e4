"""Progressive results and incremental indexing."""
