"""driftloom: temporal snapshot analytics and corpus preparation as Spark DataFrames."""

__version__ = "0.1.0"
