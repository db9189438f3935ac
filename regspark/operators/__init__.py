"""Operators on DataFrames: chunking, graph build and queries, search, interpretation, context, evaluation, upsert.

Functions that run in Python workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
