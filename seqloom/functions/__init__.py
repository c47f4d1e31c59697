"""Column functions on sequences; all are built from Spark's own expressions."""
