"""skein: a Spark-first engine for context retrieval and document analytics."""

__version__ = "0.1.0"
