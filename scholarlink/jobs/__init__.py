"""Registered jobs: each reads tables and returns one result."""
