"""Column expressions and the small Arrow helpers used inside tasks."""
