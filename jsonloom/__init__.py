"""jsonloom: analytics over large collections of JSON documents, on Spark DataFrames."""

__version__ = "0.1.0"
