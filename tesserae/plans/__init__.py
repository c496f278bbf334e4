"""Search plans."""
