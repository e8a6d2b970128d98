"""Dataflows: DataFrames in, DataFrames out."""
