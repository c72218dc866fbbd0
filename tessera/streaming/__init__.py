"""The incremental scan."""
