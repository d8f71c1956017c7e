"""Operators on edges, tiles and vectors."""
