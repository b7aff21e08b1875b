"""docscreen sources."""
