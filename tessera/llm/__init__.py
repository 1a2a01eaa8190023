"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage.  Its functions travel to
the executors by value, so a cluster needs numpy and pyarrow there, not this
repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
