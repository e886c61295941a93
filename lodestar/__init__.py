"""A PySpark-native engine for event-graph analytics, text retrieval and evaluation."""

import sys

from pyspark import cloudpickle

# functions that run on executors are shipped by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
