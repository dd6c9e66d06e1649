"""Operators for large-scale training-data pipelines, and their queries."""

import sys

from pyspark import cloudpickle

# executors get these functions with the tasks and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
