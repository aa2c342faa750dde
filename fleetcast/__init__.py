"""Forecasting of fleets of time series with external drivers, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from fleetcast.config import ForecastConfig

# Functions sent to executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ForecastConfig"]
