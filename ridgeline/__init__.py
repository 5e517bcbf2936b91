"""ridgeline: parameter-space analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
