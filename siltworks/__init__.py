"""Spark jobs for bronze-to-silver data work.

Every operator is a ``DataFrame -> DataFrame`` function, so a cleaning flow is
a chain of ``df.transform(...)`` calls. Operators that depend on the data come
in two halves: ``fit_*`` reads the data once and returns a small Python value,
``apply`` turns that value into plain column expressions.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
