"""Score tables, the JSON score files of single metrics, and the JSON summary."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from segeval.functions.expr import nan_to_null
from segeval.operators.order import ranges
from segeval.scratch import materialize

#: Most scores of one record of a score file.
RECORD_SCORES = 100_000

SCORE_FILE_SCHEMA = "metric_name string, scores array<double>, num_samples bigint, offset bigint"


def write_scores(scores: DataFrame, path: str) -> None:
    """Long scores as Parquet, one folder per metric."""
    scores.write.partitionBy("metric").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Long scores written by ``write_scores``; a filter on ``metric`` reads only its folders."""
    return spark.read.parquet(path)


def add_to_store(scores: DataFrame, path: str) -> None:
    """Append ``row_id, metric, score`` to a score store. What a job commits is there for good, whatever fails later."""
    scores.select("row_id", F.col("score").cast("double").alias("score"), "metric").write.mode("append").partitionBy("metric").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, score, metric`` of a score store, empty if there is none yet."""
    try:
        return spark.read.schema("row_id long, score double, metric string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "row_id long, score double, metric string")


def export_score_files(scores: DataFrame, path: str, key: str = "row_id") -> None:
    """JSON files of one record each: scores of a metric in key order, with the ``offset`` of the first one.

    A record holds ``RECORD_SCORES`` scores at most, whatever the size of the table. The
    ranges of keys are written to the scratch folder when this is called.
    """
    ranged = ranges(scores.select("metric", key, "score"), "metric", key)
    counts = ranged.groupBy("metric", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("metric").orderBy("part")) - F.col("n")
    before = materialize(counts.select("metric", "part", ahead.alias("ahead")), "offsets")
    place = F.row_number().over(Window.partitionBy("metric", "part").orderBy(key)) - 1
    placed = ranged.withColumn("place", place).join(before, ["metric", "part"])
    record = placed.withColumn("record", F.floor(F.col("place") / RECORD_SCORES))
    listed = record.groupBy("metric", "part", "record").agg(
        F.sort_array(F.collect_list(F.struct("place", "score"))).alias("s"), F.min(F.col("ahead") + F.col("place")).cast("bigint").alias("offset")
    )
    listed.select(
        F.col("metric").alias("metric_name"),
        F.transform("s", lambda e: e["score"]).alias("scores"),
        F.size("s").cast("bigint").alias("num_samples"),
        "offset",
    ).write.option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)


def read_score_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(metric, row_id, score)`` from JSON score files; ``row_id`` is the position in the list, after the record's offset if it has one.

    A file that cannot be read leaves its metric out.
    """
    table = spark.createDataFrame([], "metric string, row_id bigint, score double")
    for metric, path in paths.items():
        try:
            file = spark.read.schema(SCORE_FILE_SCHEMA).option("multiLine", True).json(path)
        except AnalysisException as error:
            warnings.warn(f"no scores for {metric}: {error}", stacklevel=2)
            continue
        listed = file.select(F.coalesce("offset", F.lit(0)).alias("offset"), F.posexplode("scores").alias("position", "score"))
        table = table.unionByName(
            listed.select(F.lit(metric).alias("metric"), (F.col("offset") + F.col("position")).alias("row_id"), nan_to_null(F.col("score")).alias("score"))
        )
    return table


def summary_json(correlations: DataFrame, summary: DataFrame, available: list[str], used: list[str]) -> DataFrame:
    """One row ``value``: the JSON summary of a run, from tables with one row per metric."""
    coefficients = [c for c in correlations.columns if c not in ("metric", "n", "ordinal")]
    statistics = [F.col("mean"), F.col("std_pop").alias("std"), F.col("min"), F.col("max"), F.col("count")]

    def as_map(table: DataFrame, fields) -> DataFrame:
        return table.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*fields)))).alias("m"))

    names = F.struct(F.lit(available).alias("available_metrics"), F.lit(used).alias("used_metrics"))
    document = F.struct(
        F.col("m").alias("correlation_results"),
        as_map(summary, statistics).scalar().alias("summary_statistics"),
        names.alias("registry_info"),
    )
    return as_map(correlations, coefficients).select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def write_summary(correlations: DataFrame, summary: DataFrame, available: list[str], used: list[str], path: str) -> None:
    """Write ``summary_json`` as a text folder of its own, never next to or over the data."""
    summary_json(correlations, summary, available, used).coalesce(1).write.text(path)
