"""PySpark operators for market bars and other keyed time series."""
