"""Joins, samples, windows and aggregates of the feature pipeline."""
