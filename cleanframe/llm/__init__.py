"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Python code for executors travels with the tasks, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
