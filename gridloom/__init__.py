"""gridloom: Spark-native analytics for sparse 3-D, mask and vector data.

Every operator is a plain ``DataFrame -> DataFrame`` function made of Catalyst
expressions; vectorised Python is used only where the built-ins cannot express
the semantics.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of
# this package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
