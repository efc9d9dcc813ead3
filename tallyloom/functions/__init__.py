"""Column functions: expressions only, no actions and no Python per row."""
