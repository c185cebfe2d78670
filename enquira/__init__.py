"""Spark-native analytics for education enquiries."""
