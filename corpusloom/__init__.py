"""corpusloom: a Spark-first engine for hybrid retrieval and corpus processing."""

__version__ = "0.1.0"
