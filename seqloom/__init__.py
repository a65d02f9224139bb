"""Spark-native sequence analytics: Column functions, frames, sources, alignment, trees.

Functions that run on executors are pickled by value, so a job needs no copy of
this package on the workers' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
