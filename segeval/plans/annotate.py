"""Add score columns to a CSV table of text pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segeval.functions.expr import score_column
from segeval.operators.profile import column_summary
from segeval.operators.scoring import add_scores, select_metrics
from segeval.sources.csv import read_csv, read_pairs_csv, write_csv


def annotate_csv(
    spark: SparkSession, input_path: str, output_path: str, metrics: list[str] | None = None, types: dict[str, str] | None = None
) -> DataFrame:
    """Read pairs, write them with one score column per metric, and return the statistics of the new columns."""
    names = select_metrics(metrics)
    write_csv(add_scores(read_pairs_csv(spark, input_path, types), names), output_path)
    columns = [score_column(m) for m in names]
    return column_summary(read_csv(spark, output_path, {c: "double" for c in columns}), columns)
