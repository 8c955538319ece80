"""Spark-native analytics for machine and security logs, and for training-data corpora."""
