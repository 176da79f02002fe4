"""Motion-sensor analytics on Spark: sources, alignment, segmentation, folds, filters, scoring.

The package ships its own Python functions to the executors by value, so a
cluster needs no extra ``--py-files`` step for ``mapInArrow`` and friends.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
