"""A PySpark-native engine for record matching, entity resolution and their evaluation."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
