"""sluice: a pipe-query, table and vector-search engine expressed on Spark DataFrames."""

__version__ = "0.1.0"
