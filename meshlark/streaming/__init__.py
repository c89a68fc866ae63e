"""Frames that arrive over time."""
