"""Predicate helpers: optional filters and parameter bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(**equals) -> Column:
    """AND of ``col == value`` for every truthy value; a falsy value (None
    or '') means no filter, as in the reference's ``if value:`` checks."""
    preds = [F.col(k) == F.lit(v) for k, v in equals.items() if v]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def like_any(column: str, text: str) -> Column:
    """Case-insensitive substring match; ``%`` and ``_`` in the text act as
    wildcards, like the reference's LIKE pattern."""
    return F.lower(F.col(column)).like(f"%{text.lower()}%")


def check_range(name: str, value, lo=None, hi=None) -> None:
    if lo is not None and value < lo or hi is not None and value > hi:
        raise ValueError(f"{name}={value!r} outside [{lo}, {hi}]")
