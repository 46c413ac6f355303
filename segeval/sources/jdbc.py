"""Rating tables in a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segeval.operators.ratings import join_ratings


def read_table(
    spark: SparkSession, url: str, table: str, columns: list[str], split_by: str, properties: dict[str, str], partitions: int = 32
) -> DataFrame:
    """Read columns of a table in parallel ranges of a numeric column, whose ends the database supplies."""
    ends = f'(SELECT min("{split_by}") AS lo, max("{split_by}") AS hi FROM {table}) ends'
    row = spark.read.jdbc(url, ends, properties=properties).first()
    lo, hi = (int(v) if v is not None else 0 for v in (row[0], row[1]))
    data = spark.read.jdbc(
        url, table, column=f'"{split_by}"', lowerBound=lo, upperBound=hi + 1, numPartitions=partitions, properties=properties
    )
    return data.select(*columns)


def read_rated_pairs(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    ratings_table: str,
    pairs_table: str,
    rating_key: str = "id",
    partitions: int = 32,
) -> DataFrame:
    """Ratings with the texts they rate; both tables are read in parallel and joined in Spark.

    Ratings are split by ``rating_key``, their numeric row key: ranges of the rated
    item would put all ratings of a popular item into one task.
    """
    ratings = read_table(spark, url, ratings_table, ["score", "item_id", "createdBy_id"], rating_key, properties, partitions)
    pairs = read_table(spark, url, pairs_table, ["id", "sourceText", "targetText", "targetID"], "id", properties, partitions)
    return join_ratings(ratings, pairs)
