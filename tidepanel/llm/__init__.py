"""Operators for preparing training data.

Nothing else in the library imports this subpackage. Functions that run on
executors travel with the task, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
