"""graphloom: a Spark-native engine for governed knowledge-graph queries and large-scale data processing.

Functions that Python workers run are sent to them whole, not by name: executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
