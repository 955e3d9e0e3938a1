"""Operators for building training corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job needs no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
