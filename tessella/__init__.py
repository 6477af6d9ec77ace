"""tessella: a Spark-native engine for review analytics and training-data preparation."""

__version__ = "0.1.0"
