"""Operators of a training-data pipeline; nothing else in the library imports them.

Code that runs in tasks travels with them (pickled by value), so executors need only the
installed libraries, whatever their module path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
