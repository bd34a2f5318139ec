"""Incremental forms of the stateful operators.

The stateful processor is pickled by value, so executors don't need this repository.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
