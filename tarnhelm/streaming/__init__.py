"""Streaming and ordered event folds."""
