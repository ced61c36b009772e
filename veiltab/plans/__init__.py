"""Whole runs: registry, budget, sessions."""
