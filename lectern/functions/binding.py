"""A name for an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it.

    Without this a rule that mentions its input twice would double the expression
    tree of all rules before it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
