"""Relational operators over stations, gridded fields and held-out scores."""
