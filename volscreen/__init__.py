"""A PySpark-native engine for daily price bars: features, walk-forward forecasts and their evaluation."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need not have this package on their path: functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
