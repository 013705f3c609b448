"""Scalar column functions and their SQL registration."""
