"""Scans, collation, list loaders and driver-table bindings."""
