"""gapgraph: Spark-native causal-graph analytics over text corpora.

Functions of the package are shipped to Python workers by value, so executors need no
copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
