"""Spark-native analytics for chromatography and spectroscopy runs at fleet scale."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
