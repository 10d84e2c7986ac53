"""Spark-first analytics over append-only ledgers.

The functions that run on executors travel by value, so a cluster needs no
copy of the package on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
