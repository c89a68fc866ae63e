"""Whole analyses, their settings and outputs."""
