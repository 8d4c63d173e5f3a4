"""Session settings and join shapes that hold up on large and skewed tables."""
