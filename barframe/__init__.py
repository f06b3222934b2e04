"""Price-bar panel analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what a task calls travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
