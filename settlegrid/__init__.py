"""Spark-native analytics for keyed spatial windows and corpora of their indicators."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Kernels travel to Python workers by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
