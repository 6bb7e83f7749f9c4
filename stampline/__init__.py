"""Time-stamped transcript analytics as PySpark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: those need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
