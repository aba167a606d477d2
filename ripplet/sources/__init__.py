"""Sources of the impact engine."""
