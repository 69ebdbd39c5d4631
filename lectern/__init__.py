"""Lectern: document structuring, alignment and accounting as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors then need no copy of the package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
