"""tidewell: point-in-time research analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python kernels travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
