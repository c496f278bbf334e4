"""Index construction, matching, ranking and validation."""
