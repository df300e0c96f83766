"""Operators for preparing training text at corpus scale.

The package's functions are pickled by value, so executors that do not have the
repository on their path can still run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
