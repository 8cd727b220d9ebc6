"""Whole jobs: grading, resuming, caching, and documents made from tables."""
