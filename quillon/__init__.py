"""Spark-native listing, matching, classification and cohort analytics."""
