"""Streams: incremental refresh of stores from files as they come, and windowed counts of events with late data."""
