"""quillon: a Spark-native engine for reversible anonymisation of text tables."""

__version__ = "0.1.0"
