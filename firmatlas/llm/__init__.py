"""Operators for preparing language-model training text, and their registered queries.

The functions that run in tasks are sent to executors by value, so that executors need
numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
