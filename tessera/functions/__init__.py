"""Column functions: losses, metrics and special functions."""
