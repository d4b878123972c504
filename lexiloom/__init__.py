"""Corpus analytics on Spark: positional indexes, keyness, concordance, search and vectors as lazy DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
