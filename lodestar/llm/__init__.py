"""Operators for building training corpora.

Nothing outside this subpackage imports it. Functions that run on executors are
shipped by value, so the executors do not need this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
