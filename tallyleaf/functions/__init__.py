"""Scalar functions: values, addresses, JSON text."""
