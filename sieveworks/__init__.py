"""Spark-native curation engine for text, exam and conversation records."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package are sent to the executors whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
