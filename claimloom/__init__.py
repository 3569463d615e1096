"""Claims analytics on Spark: lazy DataFrame operators for avoidable acute care."""

__version__ = "0.1.0"
