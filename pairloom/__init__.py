"""pairloom: a Spark-native engine for two-sided document matching and corpus preparation."""

__version__ = "0.1.0"
