"""PySpark analytics over versioned key-value data."""
