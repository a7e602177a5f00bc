"""A Spark-native index of source code and markdown with an evidence graph."""
