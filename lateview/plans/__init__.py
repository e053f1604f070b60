"""Contracts and decisions made before any vector is touched."""
