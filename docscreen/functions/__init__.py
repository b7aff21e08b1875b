"""docscreen functions."""
