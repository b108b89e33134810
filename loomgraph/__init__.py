"""Spark-native retrieval and graph analytics."""
