"""Operators for preparing training data: deduplication, decontamination,
mixing, classifiers, formatting and personal data. Nothing else in the library
imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules["stationflow"])
