"""Draw-series analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

from drawstat.settings import BINNED_MODELS, SINGLE_GAME, WHEEL_GAME, Game

# The Arrow helpers travel to the Python workers with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BINNED_MODELS", "SINGLE_GAME", "WHEEL_GAME", "Game"]
