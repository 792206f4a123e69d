"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this package; `queries.py` registers one
query per operator and `oracle.py` holds the SQL of those SQL can express.
"""

from pyspark import cloudpickle

import ridelens

# Functions of this package travel to the tasks by value: the Python workers
# need no copy of the package on their import path.
cloudpickle.register_pickle_by_value(ridelens)
