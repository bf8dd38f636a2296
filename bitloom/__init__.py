"""Spark-native compression, signal-coding and information-theory analytics."""
