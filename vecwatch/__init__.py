"""vecwatch: image-embedding analytics as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
