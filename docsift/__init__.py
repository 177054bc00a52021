"""docsift: index, search and describe document collections with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with each task, so that it need not
# be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
