"""strandline: indexed frames, time buckets and window analytics on Spark DataFrames."""

__version__ = "0.1.0"
