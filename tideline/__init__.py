"""Incremental machine learning over tables and row feeds, on Spark.

Rows are grouped in a caller-given order into windows; a model is retrained as
each window closes, and the closing row is returned with the model attached.
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
