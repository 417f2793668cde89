"""slicewise: screening analytics for CT slice models, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python steps travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
