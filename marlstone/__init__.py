"""A Spark-first relational engine with a small, strict SQL surface."""

__version__ = "0.1.0"
