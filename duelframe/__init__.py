"""Paired-contest analytics and record preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The executors need no copy of the package: functions and classes that tasks use travel with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
