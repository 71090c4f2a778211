"""Operators for preparing training text at scale. Nothing else in the library imports this package.

Functions that run in Python workers are sent there by value, so executors don't need the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
