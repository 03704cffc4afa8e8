"""shelfmark: file-inventory analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from shelfmark.session import build_session, checkpoint_root

# Functions of this package travel to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpoint_root"]
