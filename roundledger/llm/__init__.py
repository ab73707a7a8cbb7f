"""Operators that prepare training text: dedup, scoring, filters, mixing, packing.

Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
