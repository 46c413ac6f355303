"""CSV tables: every column is read as text, missing-value tokens become NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from segeval.functions.expr import nan_to_null
from segeval.operators.ratings import TEXT_COLUMNS, drop_null_texts, require_columns, require_rows

# Cell contents that mean "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line breaks allowed in cells.

    Columns stay strings unless ``types`` names another type; a cell that does
    not fit its type becomes NULL. With ``multi_line``, each file is read by one
    task; without it, large files are split and a cell must not hold a line break.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    types = types or {}
    require_columns(raw, types)
    columns = []
    for name in raw.columns:
        cell = F.when(~F.col(f"`{name}`").isin(*NULL_TOKENS), F.col(f"`{name}`"))
        value = cell.try_cast(types[name]) if name in types else cell
        columns.append((nan_to_null(value) if types.get(name) == "double" else value).alias(name))
    return raw.select(*columns)


def read_pairs_csv(
    spark: SparkSession,
    path: str,
    types: dict[str, str] | None = None,
    required=TEXT_COLUMNS,
    observation: Observation | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """``read_csv`` with required text columns; rows that lack one of them are dropped.

    An ``observation`` gets ``rows_read`` and ``rows_dropped`` from the first job that
    reads the whole result. No row left is an error, found by reading up to the first one.
    """
    rows = read_csv(spark, path, types, multi_line)
    require_columns(rows, required)
    if observation is not None:
        complete = F.lit(True)
        for c in required:
            complete = complete & F.col(c).isNotNull()
        rows = rows.observe(observation, F.count("*").alias("rows_read"), F.count_if(~complete).alias("rows_dropped"))
    require_rows(drop_null_texts(read_csv(spark, path, types, multi_line), required), f"no row of {path} has all of {list(required)}")
    return drop_null_texts(rows, required)


def with_row_id(df: DataFrame, out: str, name: str = "row_id") -> DataFrame:
    """Number the rows, write the table to ``out`` as Parquet and read it back.

    The ids rise in reading order and are fixed by the write, so later jobs can
    join on them.
    """
    df.select(F.monotonically_increasing_id().alias(name), "*").write.parquet(out)
    return df.sparkSession.read.parquet(out)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with headers, in a form that ``read_csv`` reads back."""
    df.write.option("header", True).option("escape", '"').csv(path)
