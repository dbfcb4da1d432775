"""Operators of a training-data pipeline: tokens, personal data, leaks, rules, copies, archives, classifiers."""
