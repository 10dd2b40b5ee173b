"""Frames, pipelines, the dependency graph and incremental recomputation: all plan DataFrames, none runs row loops."""
