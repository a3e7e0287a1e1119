"""Spark-native transport-network analytics."""
