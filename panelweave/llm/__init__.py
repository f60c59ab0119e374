"""Operators for preparing training text. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with each job, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
