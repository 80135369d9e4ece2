"""Column expressions and the building blocks for ordered work on skewed keys."""
