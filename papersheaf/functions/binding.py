"""Evaluate an expression once where the optimizer would repeat it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, as the argument of a lambda.

    A plain sub-expression is computed again for each use in a conditional, and for each element of
    an inner lambda.
    """
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """A generated column holding ``value``: later filters on it cannot be pushed below and repeat its work.

    For use as a column of a ``select``, once per ``select``.
    """
    return F.explode(F.array(value))
