"""Structured Streaming jobs with the same meaning as the batch operators."""
