"""docscreen plans."""
