"""Operators for preparing training corpora. Nothing outside this subpackage imports it.

Functions that run in executors' Python workers travel with the plan, so the cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
