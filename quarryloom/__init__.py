"""Spark-native analytics over corpora of source files and documents."""
