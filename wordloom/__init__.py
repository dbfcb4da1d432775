"""wordloom: categorised word pools, their vectors and their prompts, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
