"""Operators for preparing training text at scale; nothing else in the library imports this subpackage.

Functions of the subpackage travel to the tasks as code, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
