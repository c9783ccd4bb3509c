"""kestrel: RL post-training data jobs on Spark (see README.md)."""

import sys as _sys

# Functions of this package used inside pandas UDFs / mapInPandas are pickled
# by value, so Python workers do not need the package installed or on their
# path (e.g. a driver started from another directory).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: workers need the package installed
    pass
