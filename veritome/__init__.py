"""A Spark-first engine for evidence reconciliation over large document collections.

Functions handed to Python workers are pickled by value, so executors need
this package's dependencies but not the package itself on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
