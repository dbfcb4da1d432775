"""Structured Streaming twins of the history, state and growth operators."""
