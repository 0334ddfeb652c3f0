"""Spark-native engine for sentence-level preference data and its evaluation."""
