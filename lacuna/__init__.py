"""lacuna: Spark-native gap imputation and periodic-signal analytics."""

__version__ = "0.1.0"
