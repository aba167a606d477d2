"""Operators of the impact engine."""
