"""Search-rank and competitor-price analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so it needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
