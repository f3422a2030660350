"""Predicates composed from the arguments that are set."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions, F.lit(True))


def equals_if(column: str, value: Any | None) -> Column:
    """``column = value``, or no condition when the value is not given."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def between_if(column: str, start: dt.date | None, end: dt.date | None) -> Column:
    """Inclusive range with either end left open."""
    after = F.lit(True) if start is None else F.col(column) >= F.lit(start)
    before = F.lit(True) if end is None else F.col(column) <= F.lit(end)
    return after & before


def last_days(column: str, as_of: dt.date, days: int | None) -> Column:
    """The last ``days`` days up to ``as_of``; every row when ``days`` is None."""
    if days is None:
        return F.lit(True)
    return F.col(column) >= F.lit(as_of - dt.timedelta(days=days))


def in_month(column: str, month: str | None) -> Column:
    """Month given as ``YYYY-MM``, written as a range so that scans can prune."""
    if month is None:
        return F.lit(True)
    first = dt.date.fromisoformat(f"{month}-01")
    following = (first + dt.timedelta(days=31)).replace(day=1)
    return (F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(following))


def text_contains(column: str, part: str | None) -> Column:
    return F.lit(True) if not part else F.col(column).contains(part)
