"""Frames, columns and the edits and aggregates on them."""
