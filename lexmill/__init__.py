"""lexmill: statistics and processing of large keyed text collections on Spark."""

__version__ = "0.1.0"
