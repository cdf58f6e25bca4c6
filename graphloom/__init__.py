"""Property-graph analytics over code indexes, expressed as PySpark plans."""
