"""Grading of predictions as they arrive."""
