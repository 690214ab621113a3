"""Operators for preparing training text at scale."""

import sys

from pyspark import cloudpickle

# Executors get these functions with the job, so that nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
