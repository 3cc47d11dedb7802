"""Operators for large-scale training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
