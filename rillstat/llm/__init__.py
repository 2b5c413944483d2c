"""Operators of a training-data pipeline over tables of documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# What runs in the Python workers goes there by value: the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
