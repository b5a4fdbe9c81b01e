"""kgspark: a PySpark-native engine for grounded knowledge graphs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
