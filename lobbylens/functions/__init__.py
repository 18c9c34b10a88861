"""Column functions: pure expressions, no shuffles, no Python workers."""
