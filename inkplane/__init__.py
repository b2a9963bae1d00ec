"""inkplane: positioned-text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
