"""Market time series and text evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors with their code, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
