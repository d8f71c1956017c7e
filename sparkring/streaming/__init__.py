"""Edges that arrive over time."""
