"""Dataset quality, drift and governance on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Send the package's functions along with the tasks that use them, so that workers need no
# installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
