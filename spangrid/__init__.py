"""Spark-native analysis of source-text layout and of training-data corpora."""
