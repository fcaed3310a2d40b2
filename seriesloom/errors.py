class TimeSeriesError(ValueError):
    """Data or parameters that an operator cannot work with."""
