"""Forecasting work on many ordered value series at once, as Spark DataFrames.

Every public function takes and returns DataFrames (or Columns). The shared
table shape is ``series_id STRING, ts, value DOUBLE`` and, once indexed,
``seq BIGINT, n BIGINT, chunk BIGINT`` (see ``operators.index``).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# The small functions that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
