"""tidemark: ordered price series analytics and corpus operators as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the tasks; they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
