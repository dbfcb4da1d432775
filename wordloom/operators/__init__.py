"""Relational, pairwise and iterative operators over DataFrames."""
