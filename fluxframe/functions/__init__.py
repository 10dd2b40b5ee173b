"""Column functions: guarded arithmetic, casts, strings and time."""
