"""Scans, lookups and sinks."""
