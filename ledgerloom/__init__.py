"""Spark-native analytics over audit logs and transcripts."""
