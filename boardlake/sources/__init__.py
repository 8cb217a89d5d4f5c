"""Readers: the driver's Parquet tables and captured board payloads."""
