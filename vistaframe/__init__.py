"""Terrain visibility and evidence-aware ranking on Spark DataFrames."""
