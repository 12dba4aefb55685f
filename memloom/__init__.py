"""memloom: a Spark-first engine for agent-memory stores and corpus hygiene."""

__version__ = "0.1.0"
