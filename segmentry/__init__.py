"""Market analytics on Spark: ranked catalogs, segments, scores and reviews.

Every operator is a plain function from DataFrame to DataFrame (or Column to
Column); Spark does the partitioning, shuffling and code generation.
"""

import sys

from pyspark import cloudpickle

# the few functions that run in Python tasks travel with them, so executors need
# no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
