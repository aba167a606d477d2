"""Streaming of the impact engine."""
