"""Operators for preparing large text corpora for model training (see README, "Training-data operators").

Nothing else in the package imports this subpackage.
"""

from pyspark import cloudpickle

import ledgerline

# Functions shipped to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(ledgerline)
