"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# What runs in Python workers travels with the job: executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
