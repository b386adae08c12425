"""Scalar column helpers; all are built-in Spark expressions, none is a UDF."""
