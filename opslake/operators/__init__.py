"""Batch operators: each takes its tables (and an explicit ``as_of`` where time matters) and returns a DataFrame."""
