"""Operators that prepare text for training: duplicates, quality, language, secrets, tokens, packing.

Nothing else in the library imports this package. Its functions travel to Python workers by
value, so executors need numpy, pyarrow and the like, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
