"""Operators of a training-data pipeline: one module per operator, its query beside it."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
