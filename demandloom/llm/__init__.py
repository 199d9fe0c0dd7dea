"""Operators for training-data pipelines; nothing else in the library imports this folder.

Functions that run in tasks travel by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
