"""Exact ranks and quantiles from value histograms.

A histogram has one row per group and distinct value. It is dealt into ranges of
group and value, so a range holds no hot key, however many rows share a value. Sums
within a range, plus the totals of the ranges before it, give every value's rank.
Nothing goes through the driver, and no task orders more than a range of distinct
values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segeval.operators.grouped import group_starts
from segeval.scratch import materialize


def ranges(df: DataFrame, *keys: str, name: str = "ranges") -> DataFrame:
    """``df`` dealt into ranges of its keys and written; the range number ``part`` rises with the keys."""
    return materialize(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), name)


def _running(group: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``upto``: the weight of the smaller values of the group in the same range. Rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            first = [batch.column(g)[0].as_py() for g in group]
            starts = group_starts(batch, group)
            before = np.cumsum(weight) - weight
            offset = -before[starts]
            offset[0] = carried if first == last else 0.0
            upto = before + np.repeat(offset, np.diff(starts, append=batch.num_rows))
            last, carried = [batch.column(g)[-1].as_py() for g in group], upto[-1] + weight[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.float64())], [*batch.schema.names, "upto"])

    return run


def rank_table(counts: DataFrame, *group: str) -> DataFrame:
    """``counts`` with the weight of smaller values in the group, ``before``, and the group's weight ``n`` and ``mean``.

    ``counts`` has one row per group and ``value``, with its ``weight`` as a double, and may have more columns. Its ranges are written, with
    their running sums, when this is called; what is joined to them is one row per group and range.
    """
    dealt = counts.repartitionByRange(*group, "value").sortWithinPartitions(*group, "value")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    ranged = materialize(dealt.mapInArrow(_running(list(group)), T.StructType([*dealt.schema, T.StructField("upto", T.DoubleType())])), "ranges")
    totals = ranged.groupBy(*group, "part").agg(
        F.sum("weight").alias("__total"), F.sum(F.col("weight") * F.col("value")).alias("__values")
    )
    whole, ahead = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("part")
    offsets = totals.select(
        *group,
        "part",
        (F.sum("__total").over(ahead) - F.col("__total")).alias("__ahead"),
        F.sum("__total").over(whole).alias("n"),
        (F.sum("__values").over(whole) / F.sum("__total").over(whole)).alias("mean"),
    )
    joined = ranged.join(offsets, [*group, "part"])
    return joined.select(*counts.columns, (F.col("__ahead") + F.col("upto")).alias("before"), "n", "mean")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct finite values with their row counts: ``(grp, value, weight)``."""
    value = F.col(column).cast("double")
    return (
        df.select(F.lit("all").alias("grp"), value.alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("grp", "value")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def exact_quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with the linearly interpolated quantiles of a column, NULL and NaN skipped.

    The value at each needed position is found through exact cumulative counts,
    so no task ever holds all values. The distinct values are written when this is called.
    """
    ranked = rank_table(value_counts(df, column), "grp")

    def at(position: Column) -> Column:
        holds = (F.col("before") <= position) & (position < F.col("before") + F.col("weight"))
        return F.min(F.when(holds, F.col("value")))

    aggregates = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(share)
        aggregates += [
            at(F.floor(place)).alias(f"{name}__low"),
            at(F.ceil(place)).alias(f"{name}__high"),
            F.min(place - F.floor(place)).alias(f"{name}__part"),
        ]

    def between(name: str) -> Column:
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        return low + (high - low) * F.col(f"{name}__part")

    return ranked.agg(*aggregates).select(*[between(name).alias(name) for name in shares])


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The ``n`` rows with the smallest values of ``order``, a unique numeric row id.

    Ids are dealt into ranges, and only the range that holds the last row kept is
    looked at by value, so no task ever orders more than a range. Texts stay where
    they are and are filtered by the id of that row. The driver gets one count per
    range. Runs jobs over the ids when it is called.
    """
    ids = ranges(df.select(F.col(order).cast("long").alias("id")).where("id is not null"), "id", name="ids")
    left = n
    for row in sorted(ids.groupBy("part").count().collect()):
        if row["count"] >= left:
            within = ids.where(F.col("part") == row["part"]).orderBy("id").limit(max(left, 1))
            last = within.agg(F.max("id")).first()[0]
            return df.where((F.col(order) <= last) & F.lit(n > 0))
        left -= row["count"]
    return df
