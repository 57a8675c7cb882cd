"""Text-to-training-batch engine expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with the query, so
# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
