"""Evaluate an expression once and use it several times within one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` bound to a lambda variable.

    An outer expression used inside a lambda is evaluated again for every element; a bound
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
