"""Cairn: catalog analytics expressed as Spark DataFrame and Structured Streaming plans."""

__version__ = "0.1.0"
