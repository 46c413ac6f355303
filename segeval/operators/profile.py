"""Summary statistics, quantiles and histograms of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.expr import nan_to_null
from segeval.operators.order import exact_quantiles


def to_long(df: DataFrame, columns: list[str], keys: list[str] | None = None, name: str = "metric", value: str = "score") -> DataFrame:
    """Wide score columns to ``(keys, name, value)`` rows, as doubles."""
    keys = keys or []
    doubles = df.select(*keys, *[nan_to_null(F.col(c)).alias(c) for c in columns])
    return doubles.unpivot(keys, columns, name, value)


def _summary(value: Column, std, std_name: str) -> list[Column]:
    return [
        F.avg(value).alias("mean"),
        std(value).alias(std_name),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("count"),
    ]


def metric_summary(scores: DataFrame) -> DataFrame:
    """Per metric of a long table: mean, population deviation, min, max, count."""
    return scores.groupBy("metric").agg(*_summary(nan_to_null(F.col("score")), F.stddev_pop, "std_pop"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per score column of a wide table: mean, sample deviation, min, max, count of non-null values."""
    long = to_long(df, columns, name="column_name")
    return long.groupBy("column_name").agg(*_summary(F.col("score"), F.stddev_samp, "std_samp"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, min, exact quartiles, max."""
    value = nan_to_null(F.col(column))
    head = df.agg(*_summary(value, F.stddev_samp, "std_samp"))
    quartiles = exact_quantiles(df, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    head = head.withColumn("q", quartiles.select(F.struct("*")).scalar())
    return head.select("count", "mean", "std_samp", "min", "q.*", "max")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``(bin, bin_start, bin_end, n)`` for equal-width bins; the last bin includes the maximum, empty bins stay.

    A constant column is spread over a range of width one around its value.
    """
    value = nan_to_null(F.col(column))
    lo, hi = F.min(value), F.max(value)
    width = F.when(lo == hi, F.lit(1.0)).otherwise(hi - lo)
    edges = df.agg(F.struct(F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), width.alias("width")).alias("e"))
    edge = edges.scalar()
    index = F.least(F.floor((F.col("value") - edge["lo"]) / edge["width"] * bins), F.lit(bins - 1)).cast("int")
    counts = df.select(value.alias("value")).where(F.col("value").isNotNull()).groupBy(index.alias("bin")).count()
    frame = edges.select("e.*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width") / bins).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width") / bins).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("n"),
    )
