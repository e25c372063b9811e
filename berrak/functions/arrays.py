"""Array expressions that hold a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, as the only element of an array.

    Within a function over an array, Spark works an expression out for every element, even one that stands in a column of its own before.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
