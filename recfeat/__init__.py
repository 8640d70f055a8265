"""Recommendation-data preparation and evaluation on Spark."""
