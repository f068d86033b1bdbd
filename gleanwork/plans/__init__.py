"""Whole flows: code requests and documentation requests."""
