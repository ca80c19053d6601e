"""Spark-native analytics for software-message catalogues and text corpora."""
