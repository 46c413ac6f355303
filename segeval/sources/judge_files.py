"""JSON-lines files exchanged with a judge service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segeval.operators.judge import parse_results

# Fixed value: most requests one batch may hold.
REQUESTS_PER_FILE = 100_000


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON request per line, in files the service accepts."""
    requests.select("request").write.option("maxRecordsPerFile", REQUESTS_PER_FILE).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``(custom_id, status, score)`` from result files."""
    return parse_results(spark.read.text(path))
