"""Operators of a training-data pipeline; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Executors get this folder's functions with each task, whether or not they have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
