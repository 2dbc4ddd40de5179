"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. Its functions are shipped to Python
workers by value, so executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
