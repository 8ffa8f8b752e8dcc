"""codeloom: property-graph and corpus analytics for source code, on Spark DataFrames."""

__version__ = "0.1.0"
