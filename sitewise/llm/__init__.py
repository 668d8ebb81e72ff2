"""Operators for preparing training text: each in a module of its own, registered in ``queries``."""

import sys

from pyspark import cloudpickle

# the functions of these modules travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
