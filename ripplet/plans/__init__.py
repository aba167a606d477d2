"""Plans of the impact engine."""
