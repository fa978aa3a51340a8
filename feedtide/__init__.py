"""Feed-trend analytics as plain Spark jobs: every operator maps DataFrames to a DataFrame."""

import sys

from pyspark import cloudpickle

# The small helpers that run in Python workers travel with the task, so that
# executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
