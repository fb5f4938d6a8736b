"""A Spark-native engine for corpora, vocabularies and statistical language models."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry what they use.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
