"""lendframe: loan-table preparation, enrichment and scoring on Spark.

Sub-packages
------------
sources    readers and writers (CSV with null tokens, prediction files,
           image folders, test tables and stand-in views)
functions  Column -> Column helpers (text, tags, math) and fixed values
operators  DataFrame -> DataFrame jobs (amounts, categories, tags, target,
           ensemble, metrics, covariate shift, images, models, ranks)
plans      the named queries and their SQL oracles
streaming  the row-local enrichment as a Structured Streaming job
"""

__version__ = "0.1.0"

# Functions that run in Python workers (grouped pandas functions, the encoder
# hook) are shipped by value, so the workers need not have this package on
# their path: it works the same when the package is shipped with --py-files
# and when only the driver can import it.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
