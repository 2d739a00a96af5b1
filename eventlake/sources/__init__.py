"""Scans: streams, bronze files, partner snapshots, catalog tables and generated rows."""
