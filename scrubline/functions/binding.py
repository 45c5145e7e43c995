"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    Chains of patterns over a cell go through here. Written out in place they would be repeated
    wherever their result is used, and for wide tables they would push the stage's generated loop
    past the size the JVM compiles, which costs far more than the call.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
