"""Marginals kept up to date on a stream."""
