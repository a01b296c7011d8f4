"""Spark-native spatial transport appraisal and corpus analytics."""
