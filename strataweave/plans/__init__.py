"""Lineage cuts, skew-safe joins and session settings."""
