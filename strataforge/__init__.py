"""strataforge: a Spark-first engine for ingesting, searching and measuring technical evidence."""

__version__ = "0.1.0"
