"""News coverage analytics expressed as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# executors need no copy of this package: the few Python functions travel with their tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
