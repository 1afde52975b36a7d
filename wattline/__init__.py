"""wattline: interval time-series analytics for electricity markets on PySpark."""

__version__ = "0.1.0"
