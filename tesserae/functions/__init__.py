"""Text functions and scores."""
