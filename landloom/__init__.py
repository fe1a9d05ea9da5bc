"""landloom: geospatial land-use analytics expressed as Spark DataFrame jobs.

Layout
------
``functions``  column expressions (projection, geometry, tag rules, rasters)
``sources``    readers that return DataFrames
``sinks``      writers
``operators``  DataFrame -> DataFrame operators
``plans``      composed jobs (tiling, derivation, catalog build, sampling)
``streaming``  on-demand tile reads
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so a cluster needs no
# copy of this package on its executors.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
