"""Conversation analytics on Spark: batch and streaming jobs over logged turns."""

import sys

from pyspark import cloudpickle

# Python functions reach the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
