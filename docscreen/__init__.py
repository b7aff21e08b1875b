"""docscreen: document screening and corpus preparation as PySpark DataFrame operators."""
