"""Composed pipelines: selection, pool analysis, template profiles, batch generation."""
