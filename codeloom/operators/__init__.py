"""DataFrame operators over graphs and snapshots."""
