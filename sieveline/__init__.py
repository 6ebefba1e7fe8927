"""Spark-native building blocks for labelling, splitting, scoring and monitoring tables."""
