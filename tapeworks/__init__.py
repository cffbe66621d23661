"""Spark jobs for equity research at scale: DataFrame in, DataFrame out."""
