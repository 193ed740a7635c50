"""Spark-native analytics over recognised document regions.

Functions that run in Python workers are pickled by value, so that executors
need numpy, pandas and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
