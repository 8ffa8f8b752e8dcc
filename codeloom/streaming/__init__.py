"""Keyed event folds, as batch operators and as Structured Streaming queries."""
