"""sortweave: fixed-width record sorting, partitioning and verification on Spark DataFrames."""

__version__ = "0.1.0"
