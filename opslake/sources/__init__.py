"""Readers and writers at the edge of the engine."""
