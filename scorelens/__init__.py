"""DataFrame operators for tables that feed, record and watch a binary classifier."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
