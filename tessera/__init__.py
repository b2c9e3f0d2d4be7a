"""Spark-native eligibility, document and change analytics."""
