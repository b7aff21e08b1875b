"""docscreen operators."""
