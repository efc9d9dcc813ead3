"""Tallyloom: decision-evaluation analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
