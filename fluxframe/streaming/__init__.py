"""Structured Streaming: windows under watermarks, stateful folds, sinks."""
