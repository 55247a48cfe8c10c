"""echofold: exact and near-duplicate detection analytics expressed as Spark DataFrames."""

__version__ = "0.1.0"
