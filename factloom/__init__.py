"""Spark-native engine for checked, comparable facts out of document text."""
