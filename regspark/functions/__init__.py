"""Column expressions: text, vectors, scores. What runs in Python workers is pickled by value."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
