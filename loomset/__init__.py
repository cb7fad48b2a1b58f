"""Gene-set integration and enrichment as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in tasks travel with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
