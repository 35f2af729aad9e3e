"""Numerics that Spark has no built-in functions for."""
