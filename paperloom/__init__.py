"""Document analytics, question answering data and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
