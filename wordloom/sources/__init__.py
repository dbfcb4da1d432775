"""Scans and sinks: pools, templates, vectors, history, reports."""
