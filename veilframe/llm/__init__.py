"""Operators for building training data: each takes and gives DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
