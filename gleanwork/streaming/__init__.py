"""Streaming forms of request routing and duplicate removal."""
