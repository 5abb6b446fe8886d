"""Spark-native preparation, benchmarking and boosting of large tabular data."""

import sys

from pyspark import cloudpickle

# the few functions that run inside tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
