"""Operators for training-data pipelines: filtering, deduplication, scoring, tokenisation and archives."""
