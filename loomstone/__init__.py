"""loomstone: hybrid retrieval and corpus processing expressed as Spark plans."""

__version__ = "0.1.0"
