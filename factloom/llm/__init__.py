"""Operators that prepare text and records for training large language models."""
