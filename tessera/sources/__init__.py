"""Scans of binary files and of earlier runs' artifacts."""
