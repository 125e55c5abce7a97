"""Structured Streaming forms of the engine's folds."""
