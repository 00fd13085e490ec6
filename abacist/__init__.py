"""abacist: Spark jobs over arithmetic-puzzle tables and free-text answers to them."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
