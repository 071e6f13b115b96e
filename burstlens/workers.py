"""Code that runs in Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_code() -> None:
    """Send this package's code along with the tasks that use it.

    Workers then need no installed copy of the package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
