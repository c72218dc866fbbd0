"""Policies, classification ladders and the end-to-end run."""
