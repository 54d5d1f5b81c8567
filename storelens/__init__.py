"""Store analytics on Spark.

Functions and classes that run in Python workers are sent by value, so executors
need only the public libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
