"""Operators for preparing training data; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Task code travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
