"""Catalogue search and enrichment on Spark: DataFrame in, DataFrame out."""
