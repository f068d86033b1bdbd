"""Outputs: keyed tables, manifests and run logs."""
