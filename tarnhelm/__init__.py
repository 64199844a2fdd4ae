"""tarnhelm: finding and removing sensitive data in large document tables, on Spark."""

__version__ = "0.1.0"
