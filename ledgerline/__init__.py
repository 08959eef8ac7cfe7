"""ledgerline: retail sales analytics as Spark DataFrame jobs.

Every job takes a :class:`~ledgerline.model.SalesModel` (the logical tables) plus plain
parameters and returns a lazy DataFrame; nothing row-sized is collected to the driver.
"""

import sys

from pyspark import cloudpickle

from ledgerline.model import SalesModel
from ledgerline.session import build_session, checkpoint_dir

__all__ = ["SalesModel", "build_session", "checkpoint_dir"]

# Functions shipped to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
