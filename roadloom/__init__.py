"""roadloom: a Spark-first engine for road-survey records and training-data preparation."""

__version__ = "0.1.0"
