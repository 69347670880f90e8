"""Spark-native analytics over noisy combat and activity logs."""
