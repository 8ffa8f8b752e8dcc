"""Readers: Parquet tables, source trees, archives, snapshots."""
