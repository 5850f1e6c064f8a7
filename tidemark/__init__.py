"""Spark-first analytics over surveyed objects, their detections and rasters.

Functions of this package that run inside Python workers are sent to the
executors by value, so a cluster needs no copy of the package on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
