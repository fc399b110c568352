"""helixlake: life-science file formats, functions and data-cleaning operators as Spark DataFrames."""

__version__ = "0.1.0"
