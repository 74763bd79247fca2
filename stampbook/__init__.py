"""Registry analytics on Spark: marks, owners, transfer documents and the pages they were read from."""

__version__ = "0.1.0"
