"""cladeworks: comparative analysis of taxa, characters, distances, splits, trees and networks on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers are pickled by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
