"""quern: a Spark-native analytics engine for web-research data."""

__version__ = "0.1.0"
