"""Filters whose arguments may be absent."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, *filters: tuple[Any, Callable[[Any], Column]]) -> DataFrame:
    """Apply each ``(argument, predicate)`` whose argument is given.

    An absent argument (None) adds nothing to the plan, so the live predicates reach
    the scan as they are.
    """
    for argument, predicate in filters:
        if argument is not None:
            df = df.where(predicate(argument))
    return df


def within_days(
    df: DataFrame, column: str, from_date: dt.date | None, to_date: dt.date | None, day: str | None = None
) -> DataFrame:
    """Rows whose time falls on a day from ``from_date`` to ``to_date``, both included.

    ``day`` names a DATE column of the same moment, if the table has one: the scan can skip files and row groups by it,
    which it cannot by times without a zone.
    """
    if day in df.columns:
        return optional_filters(df, (from_date, lambda d: F.col(day) >= F.lit(d)), (to_date, lambda d: F.col(day) <= F.lit(d)))
    own = F.col(column).cast("date")
    return optional_filters(df, (from_date, lambda d: own >= F.lit(d)), (to_date, lambda d: own <= F.lit(d)))
