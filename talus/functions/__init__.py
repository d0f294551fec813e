"""Scalar expressions as SQL text."""
