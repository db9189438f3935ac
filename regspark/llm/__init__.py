"""Operators for preparing training data: licences, near copies, PII, tokens, URLs, quality, packing.

The rest of the library never imports this subpackage.  Functions that run in
Python workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
