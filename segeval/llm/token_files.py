"""Token ids in ORC files: one row per document, in ascending ``doc_id`` order.

ORC stores the ids with integer run-length encoding and no general compression on top, which
would take time and save little. Row indexes hold the range of
``doc_id`` of every 10,000 rows, and Bloom filters tell which row groups may hold
an id, so a reader of one document skips stripes and row groups by metadata alone.
Stripes are read in parallel.

Edge cases: a null or empty text has the end id alone; rows without ``doc_id`` come
first; rows of equal ``doc_id`` are put in the order of their texts' 128-bit hashes and kept
each. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segeval.llm.tokens import END_ID, encoder
from segeval.scratch import materialize, scratch_root

BLOOM_RATE = "0.01"
STRIPE_BYTES = 16 << 20

#: Documents that are encoded and handed on together.
BATCH_ROWS = 2_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode whole texts, append the end id, and write ``doc_id, part, row, ids``.

    Texts are dealt once, into ranges of ``doc_id``, and encoded where they land;
    each range is one file, numbered by ``part``.
    """
    end = END_ID.to_bytes(4, "little")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        done = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(begin, BATCH_ROWS)
                ids = [i + end for i in encode(some.column("text").to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])])
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                rows = pa.array(np.arange(done, done + len(ids)))
                done += len(ids)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("part"), rows, lists], ["doc_id", "part", "row", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    # Equal ids share a range, because it is cut by the id alone.
    dealt = rows.repartitionByRange(order[0]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    files = dealt.mapInArrow(encoded, "doc_id long, part int, row long, ids array<int>")
    writer = files.write.option("compression", "none").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_RATE)
    writer.option("orc.create.index", "true").option("orc.stripe.size", str(STRIPE_BYTES)).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, row, ids`` of token files. A filter on ``doc_id`` prunes by index and Bloom filter."""
    return spark.read.schema("doc_id long, part int, row long, ids array<int>").orc(path)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        offsets = lists.offsets.to_numpy().tolist()
        raw = memoryview(np.ascontiguousarray(values)).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
        counts = np.diff(offsets).astype(np.int64)
        columns = [batch.column(c) for c in ("doc_id", "part", "row")] + [pa.array(counts), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def token_digest(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of token files.

    A file's documents are numbered by sums within the file; the files' totals, one row each, give where a file starts.
    """
    schema = "doc_id long, part int, row long, n_tokens long, ids_crc32 long"
    rows = materialize(files.mapInArrow(_summed, schema), "digests")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    ahead = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")
    totals = totals.select(F.col("part").alias("__part"), ahead.alias("ahead"))
    upto = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row"))
    joined = rows.withColumn("upto", upto).join(totals, F.col("part") == F.col("__part"))
    start = F.col("ahead") + F.col("upto") - F.col("n_tokens")
    return joined.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write token files, to a scratch folder if no path is given, and return their digest as read back."""
    path = path or f"{scratch_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return token_digest(read_token_files(docs.sparkSession, path))
