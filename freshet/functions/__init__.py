"""Scalar expressions and their SQL registration."""
