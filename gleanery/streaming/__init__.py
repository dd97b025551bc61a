"""Incremental form of the per-page step."""
