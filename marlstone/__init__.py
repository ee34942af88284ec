"""A PySpark-native analytics engine for media references, documents, transcripts, embeddings and ordinary tables."""

import sys

from pyspark import cloudpickle

# Functions that run in executors' Python workers travel with the plan, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
