"""Keyword and n-gram mining over large text feeds, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
