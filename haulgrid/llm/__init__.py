"""Operators over documents and pages for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
