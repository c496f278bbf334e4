"""Document sources."""
