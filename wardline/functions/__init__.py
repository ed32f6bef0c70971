"""Scalar functions and parameter parsing."""
