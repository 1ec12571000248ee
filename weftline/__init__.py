"""weftline: ranked retrieval, entity statistics and text-corpus operators as Spark DataFrame jobs."""

__version__ = "0.1.0"
