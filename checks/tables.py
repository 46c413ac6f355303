"""Stand-ins for rating data, derived from the given tables; no translation data exists there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as candidates and as their own sources, benchmark texts as references, the document source as rater."""
    benchmark = table(spark, sf_dir, "benchmark")
    size = benchmark.agg(F.count("*")).scalar()
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    documents = table(spark, sf_dir, "documents").join(labels, "doc_id").withColumn("item_id", F.col("doc_id") % size)
    return documents.join(benchmark.withColumnRenamed("text", "referenceText"), "item_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("createdBy_id"),
        "score",
        F.col("text").alias("sourceText"),
        F.col("text").alias("targetText"),
        "referenceText",
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as sources, the assistant's next turn as candidate, benchmark texts as references."""
    turns = table(spark, sf_dir, "conversations")
    benchmark = table(spark, sf_dir, "benchmark")
    size = benchmark.agg(F.count("*")).scalar()
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("sourceText"))
    answered = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("targetText"))
    pairs = asked.join(answered, ["conv_id", "turn"]).withColumn("item_id", F.col("conv_id") % size)
    return pairs.join(benchmark.withColumnRenamed("text", "referenceText"), "item_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "sourceText", "targetText", "referenceText"
    )


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ratings: the user rates, the value is the score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("createdBy_id"), F.col("value").alias("score")
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tied event attributes as metrics, the value as human score."""
    events = table(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("value").alias("human"),
        F.hour("ts").cast("double").alias("hour"),
        key.alias("key"),
    ).unpivot(["row_id", "human"], ["hour", "key"], "metric", "score")


LINE_METRICS = ("l_quantity", "l_discount", "l_tax")


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three heavily tied line item columns as metrics, the price as human score."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_extendedprice").alias("human"), *LINE_METRICS).unpivot(
        ["human"], list(LINE_METRICS), "metric", "score"
    )
