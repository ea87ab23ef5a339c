"""Training-data operators: corpus cleaning, classification, sharding and archives.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel inside the task, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
