"""Relational operators: flatten, align, verdicts, scores, summaries, profiles, schemas."""
