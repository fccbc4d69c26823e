"""Operations on training-data corpora: each module holds one operator and its query."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to Python workers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
