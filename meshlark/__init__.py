"""Spatial order in time series of segmentations and point sets, as Spark DataFrames."""

__version__ = "0.1.0"
