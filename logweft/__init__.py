"""Log-sequence analytics as Spark DataFrame and Structured Streaming jobs."""
