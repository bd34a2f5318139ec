"""Operators for preparing text corpora.

Nothing else in the library imports this package.  Functions that run inside tasks are
pickled by value, so executors need only the public libraries, not this repository.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
