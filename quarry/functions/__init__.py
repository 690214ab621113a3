"""Column builders without input or output."""
