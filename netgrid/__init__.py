"""Spark-native operators over gridded detections and line networks."""
