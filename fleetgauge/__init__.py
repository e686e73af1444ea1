"""Fleet telemetry analytics as lazy Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions travel to the workers whole, so that nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
