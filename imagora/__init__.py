"""Retrieval experiments as Spark jobs: DataFrame in, DataFrame out."""
