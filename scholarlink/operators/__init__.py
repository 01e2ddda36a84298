"""Joins and windows that link and rank people, works and evidence."""
