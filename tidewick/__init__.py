"""Spark-native market-structure analytics and training-data operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: no install step there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
