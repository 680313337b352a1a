"""Binding an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda evaluates the plain expressions in its body again for every element, so an array used
    inside another array's lambda has to be bound to a lambda variable first.
    """
    return F.get(F.transform(F.array(value), body), 0)
