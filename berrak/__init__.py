"""Plain-language auditing of text corpora on Spark."""

__version__ = "0.1.0"
