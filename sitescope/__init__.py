"""Site analytics on Spark: crawl facts, audit rules, issue tracking and search performance as DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors by value, so that a cluster needs no copy of it.
register_pickle_by_value(sys.modules[__name__])
