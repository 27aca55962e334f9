"""Analytics over personal and small-business ledgers on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors carry their code with them: executors need not
# have this package on their path.
register_pickle_by_value(sys.modules[__name__])
