"""Functions of the impact engine."""
