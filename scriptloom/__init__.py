"""Columnar processing of structured scripts and training text on Spark."""

import sys

__version__ = "0.2.0"
#: The interpreter that runs the library.
__py_runtime__ = sys.version
