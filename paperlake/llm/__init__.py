"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions of this package go to the executors by value, so they need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
