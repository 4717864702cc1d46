"""Whole pipelines, their table bindings and their oracle SQL."""
