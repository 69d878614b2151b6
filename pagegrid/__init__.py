"""pagegrid: page-layout analytics over large page collections, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors by value: these need numpy, pandas and pyarrow, but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
