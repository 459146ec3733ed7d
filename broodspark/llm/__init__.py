"""Operators of a training-data pipeline, each on a table of documents.

Functions that run in Python workers are sent with the query, so the workers need not have
this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
