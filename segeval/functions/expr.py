"""Small building blocks shared by the column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A higher-order function evaluates an outer expression again for every array
    element; binding it to a lambda variable keeps such expressions linear.
    """
    return F.transform(F.array(value), body)[0]


def finite(value: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def nan_to_null(value: Column) -> Column:
    """Turn NaN into NULL, the only missing value used inside the library."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def score_column(metric: str) -> str:
    """Name of the wide score column of a metric, such as ``chrfplusplus_score``."""
    return metric.lower().replace("+", "plus").replace("-", "_") + "_score"


def score_column_expr(metric: Column) -> Column:
    """``score_column`` for metric names held in a column."""
    return F.concat(F.replace(F.replace(F.lower(metric), F.lit("+"), F.lit("plus")), F.lit("-"), F.lit("_")), F.lit("_score"))
