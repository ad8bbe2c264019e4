"""A Spark-native engine for curated atlas data: closed-world queries, relational operators and data-quality operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
