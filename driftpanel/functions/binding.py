"""Naming a value inside an expression.

A Column is a tree: a value used twice is written, and possibly computed, twice.
Inside a lambda it would even be computed for every element. A lambda variable is
computed once per row, and the optimizer does not write it out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def bind_all(body: Callable[[Column], Column], **values: Column) -> Column:
    """Like ``bind`` for several values, read as fields of the bound struct."""
    return bind(F.struct(*[value.alias(name) for name, value in values.items()]), body)
