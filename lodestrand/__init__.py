"""lodestrand: a Spark-first analytics engine for path-named time series."""

__version__ = "0.1.0"
