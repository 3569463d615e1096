"""Pipelines assembled from the operators."""
