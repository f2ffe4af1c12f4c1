"""Operators for preparing a training corpus: filters, deduplication, mixing, encoding, sharding.

Nothing else in the library imports this subpackage. Its functions travel to the executors with the
jobs that use them, so executors need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
