"""Scoring of structured document extraction, as Spark jobs."""
