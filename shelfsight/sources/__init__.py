"""Scans, sinks and the adapters from the driver's tables."""
