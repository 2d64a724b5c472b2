"""Interval time-series analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel inside the job itself, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
