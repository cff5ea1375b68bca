"""Operators for training-data pipelines, each one a Spark job."""
