"""loadlens: DataFrame operators for meter and sensor time series on Spark."""

__version__ = "0.1.0"
