"""Stores: derived snapshots with a manifest, recording datasets, Delta tables, and a durable catalog."""
