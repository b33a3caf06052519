"""Scalar functions as Spark columns, and the Python kernels behind Arrow UDFs."""
