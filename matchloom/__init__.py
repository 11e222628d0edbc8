"""matchloom: schema-matching analytics expressed as Spark DataFrame operators.

Python functions of this package travel to the workers by value, so a cluster
needs no installed copy of the package on its executors.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
