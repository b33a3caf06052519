"""tracesift: credential-flow analysis and corpus preparation as Spark DataFrame operations."""
