"""Composable data pipelines that compile to Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python kernels travel inside the task, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
