"""Column-level helpers; every function returns a native Spark Column (no UDFs)."""
