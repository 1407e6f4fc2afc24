"""Curating large media collections on Spark: catalog, ingest, exact neighbours, review sampling and folding."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
