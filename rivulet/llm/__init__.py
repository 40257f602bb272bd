"""Training-data operators: scoring, de-duplication, scans, extraction and packing.

Nothing else in the library imports this package.  Functions of this package
are pickled by value, so Python workers need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
