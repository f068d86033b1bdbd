"""Corpus gathering on Spark: requests, catalog lookup, links, crawls, files, pages.

Every operator takes and returns DataFrames (or Columns); nothing here collects
rows to the driver except aggregate values and lists of fixed size.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the task, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
