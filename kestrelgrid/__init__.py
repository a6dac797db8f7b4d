"""Spark-native analytics over occurrence records, pixel tables and species surfaces."""
