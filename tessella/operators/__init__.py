"""Retrieval operators: DataFrame in, DataFrame out."""
