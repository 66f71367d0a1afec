"""Financial reconciliation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Helper functions travel to executors by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
