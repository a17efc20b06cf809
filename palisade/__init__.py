"""Security analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the small Python helpers with each job, so that executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
