"""loomstone: a Spark-first engine for knowledge-graph query workloads."""

__version__ = "0.1.0"
