"""Operators that prepare text corpora for training. Nothing else imports them."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so that workers need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
