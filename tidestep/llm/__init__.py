"""Operators for large training corpora. Nothing else in the library imports this subpackage.

Functions that run in Python workers travel by value, so executors need only the
public packages and not a copy of this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
