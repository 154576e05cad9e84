"""Incremental scans of change sets."""
