"""Event-lake analytics expressed as PySpark DataFrame and Structured Streaming operators."""
