"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that is used inside the lambda of a higher-order function is computed for every
    element, also after the optimizer has merged a projection that computed it before.  Bound as a
    lambda variable it is a value.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]
