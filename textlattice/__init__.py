"""textlattice: corpus statistics, n-gram language models, word lattices and user history as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
