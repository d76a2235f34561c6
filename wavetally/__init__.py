"""Score speech models on whole tables with Spark.

References, predictions and frame tables come in as DataFrames; scores,
rejected samples and summaries leave as DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job; executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
