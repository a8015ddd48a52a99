"""Regression and causal analytics on Spark tables."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
