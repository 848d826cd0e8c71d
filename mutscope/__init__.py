"""mutscope — Spark-native analytics for protein-variant active-learning runs."""

__version__ = "0.1.0"
