"""Scalar functions and text building."""
