"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage. Its kernels are pickled by value, so
executors need numpy and pyarrow but not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
