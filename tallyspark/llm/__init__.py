"""Operators for training-data pipelines; nothing else in the package imports them.

Their functions travel to the executors by value, so workers need not have this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
