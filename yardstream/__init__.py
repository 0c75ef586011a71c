"""yardstream: vehicle-gate analytics as PySpark DataFrame and streaming operators."""

import sys

from pyspark import cloudpickle

from yardstream.session import build_session

# Functions of this package travel to the Python workers by value, so neither
# executors nor the streaming worker of the driver need it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
