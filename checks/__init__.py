"""Registered queries, their inputs derived from the test tables, and the SQL to compare with."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
