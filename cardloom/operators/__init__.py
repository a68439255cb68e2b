"""Relational operators of the memory engine."""
