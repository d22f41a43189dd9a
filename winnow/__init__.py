"""Curation of dated text items as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
