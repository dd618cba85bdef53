"""courtflow: tracking analytics and label-quality operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Step functions travel to the Python workers by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
