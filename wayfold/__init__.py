"""wayfold: browsing-history analytics and corpus preparation as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
