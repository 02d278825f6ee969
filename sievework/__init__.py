"""Sievework: data-quality repair, drift watching, retrieval and log accounting as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the workers inside the tasks that use them, so executors need
# pandas and numpy but no copy of the package itself.
register_pickle_by_value(sys.modules[__name__])
