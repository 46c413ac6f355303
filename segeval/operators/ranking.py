"""Rank metrics by their correlations; tables of a few rows, one per metric.

Input rows carry ``ordinal``, the position in which the metrics were listed; it
decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.significance import significance_class
from segeval.operators.correlation import COEFFICIENTS


def with_ordinal(correlations: DataFrame, names: list[str]) -> DataFrame:
    """Add the listing position of every metric; unlisted metrics come last."""
    position = F.array_position(F.array(*map(F.lit, names)), F.col("metric"))
    return correlations.withColumn("ordinal", F.when(position > 0, position - 1).otherwise(len(names)).cast("int"))


def average_correlation() -> Column:
    """Mean of the coefficients that are present; NULL if none is."""
    present = F.filter(F.array(*COEFFICIENTS), lambda c: c.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, c: acc + c)
    return F.try_divide(total, F.size(present))


def _best(value: Column) -> Column:
    return F.max_by("metric", F.when(value.isNotNull(), F.struct(value, -F.col("ordinal"))))


def best_metrics(correlations: DataFrame) -> DataFrame:
    """One row: the best metric by each coefficient and by their average."""
    return correlations.agg(
        *[_best(F.col(c)).alias(f"best_{c}") for c in COEFFICIENTS], _best(average_correlation()).alias("best_overall")
    )


def average_correlations(correlations: DataFrame) -> DataFrame:
    """``(metric, ordinal, avg_correlation)`` for metrics with any coefficient."""
    averaged = correlations.select("metric", "ordinal", average_correlation().alias("avg_correlation"))
    return averaged.where(F.col("avg_correlation").isNotNull())


def top_metrics(correlations: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` metrics with the highest average correlation."""
    return average_correlations(correlations).orderBy(F.desc("avg_correlation"), "ordinal").limit(n)


def significance(correlations: DataFrame) -> DataFrame:
    """``(metric, min_p_value, significance)`` by the smallest available p-value."""
    p_values = [F.col(f"p_value_{c}") for c in COEFFICIENTS]
    return correlations.select(
        "metric", F.least(*p_values).alias("min_p_value"), significance_class(*p_values).alias("significance")
    )
