"""docscreen streaming."""
