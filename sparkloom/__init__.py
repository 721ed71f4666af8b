"""Spark-native analytics patterns: relational basics, data algorithms, log analytics and streams."""
