"""Readers and writers: manifests, golds, predictions, runs."""
