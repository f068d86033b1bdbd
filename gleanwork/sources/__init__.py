"""Inputs: search payloads, archives, trees, pages, requests."""
