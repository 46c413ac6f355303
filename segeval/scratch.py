"""Shared scratch tables, used to cut lineage before a plan reads a result many times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for scratch tables: the cluster's checkpoint folder, else a private one on a single machine.

    Off a local master, a folder on one machine would be invisible to the others, so
    a missing setting is an error there.
    """
    application = spark.sparkContext.applicationId
    root = spark.conf.get(_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {_CONF} to a folder that all machines share; the master is {master}")
        root = _fallback.get(application) or _fallback.setdefault(application, tempfile.mkdtemp(prefix="segeval-"))
    return f"{root.rstrip('/')}/segeval/{application}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back.

    Readers of the table get column pruning and survive the loss of executors,
    because the table lives in shared storage and not in executor memory.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Results that read them must be written first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
