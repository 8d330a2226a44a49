"""Bill-processing analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to the executors with the task itself, so a
# cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
