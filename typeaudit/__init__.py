"""Code-quality analytics over large collections of source files, on Spark DataFrames."""

__version__ = "0.1.0"
