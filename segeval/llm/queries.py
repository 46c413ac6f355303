"""The operators of this package over the whole given tables, one query each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segeval.llm.impact import top_k
from segeval.llm.importance import importance_ranks
from segeval.llm.lines import drop_repeated_lines
from segeval.llm.mixing import mix_documents
from segeval.llm.packing import pack
from segeval.llm.personal import personal_spans, span_digest
from segeval.llm.quality import quality_scores
from segeval.llm.resharding import OLD_SHARDS, carry_out, plan_moves
from segeval.llm.simhash import near_duplicates
from segeval.llm.syncmers import fingerprint_edits
from segeval.llm.token_counts import token_counts
from segeval.llm.token_files import encode_documents
from segeval.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress_vectors
from segeval.scratch import scratch_root

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

#: Queries of the vector search are the vectors whose ids it divides.
EVERY = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(_table(spark, sf_dir, "documents"), ["doc_id"])
    shards = F.transform("draws", lambda d: d["shard"])
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", shards.alias("shards"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), ["doc_id"], "doc_id")
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(personal_spans(_table(spark, sf_dir, "documents")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeated_lines(_table(spark, sf_dir, "documents"), ["doc_id"])
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents lie by source in 32 shards of very different sizes and move to 40 even ones. Columns are of the shards as read back."""
    docs = _table(spark, sf_dir, "documents")
    moves = plan_moves(docs, ["doc_id", "source"], F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)))
    placed = carry_out(docs, moves, f"{scratch_root(spark)}/shards-{uuid.uuid4().hex}")
    none = F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"), "old_shard")


def op8_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path(TOKENIZER))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ["doc_id"])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_syncmers, op2_mixing, op3_simhash, op4_quality, op5_personal,
        op6_lines, op7_resharding, op8_impact, op9_packing, op10_token_files,
        op11_importance, op12_token_counts, op13_vector_codes,
    )
}

def _vector_codes_sql() -> str:
    """All rounds spelt out. Components are whole doubles, whose products and sums are exact."""
    steps = [
        f"""
        kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        parts AS MATERIALIZED (
            SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x
            FROM kept, range({PARTS}) AS p(part)
        ),
        book0 AS MATERIALIZED (
            SELECT part, entry, x
            FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) JOIN parts USING (vec_id)
            WHERE entry < {ENTRIES}
        )"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""
        near{i} AS MATERIALIZED (
            SELECT vec_id, part, arg_min(entry, [d, entry]) AS entry, min(d) AS d
            FROM (
                SELECT p.vec_id, part, b.entry,
                    list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS d
                FROM parts p JOIN book{i} b USING (part)
            )
            GROUP BY vec_id, part
        )"""
        )
        if i < ROUNDS:
            steps.append(
                f"""
        means{i} AS (
            SELECT part, entry, list(mean ORDER BY position) AS x
            FROM (
                SELECT part, entry, position, floor(sum(value) / count(*)) AS mean
                FROM (SELECT part, entry, unnest(x) AS value, unnest(range(len(x))) AS position FROM near{i} JOIN parts USING (vec_id, part))
                GROUP BY part, entry, position
            )
            GROUP BY part, entry
        ),
        book{i + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN means{i} m USING (part, entry)
        )"""
            )
    return f"""
        WITH {",".join(steps)},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
            FROM near{ROUNDS} GROUP BY vec_id
        ),
        whole AS (
            SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) AS digest
            FROM book{ROUNDS}
        )
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id), whole
    """


ORACLES: dict[str, str] = {
    "op11_importance": rf"""
        WITH RECURSIVE crc_bits(value, crc, bit) AS (
            SELECT i, i, 0 FROM range(256) AS t(i)
            UNION ALL
            SELECT value, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, {0xEDB88320}) ELSE crc >> 1 END, bit + 1 FROM crc_bits WHERE bit < 8
        ),
        crc_table AS (SELECT list(crc ORDER BY value) AS crcs FROM crc_bits WHERE bit = 8),
        cut AS (
            SELECT kind, id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT 's' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)
        ),
        counted AS MATERIALIZED (
            SELECT kind, id, feature, count(*) AS n
            FROM (
                SELECT kind, id, unnest(
                    w || list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])
                    || list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS feature
                FROM cut
            )
            GROUP BY kind, id, feature
        ),
        bytes AS (SELECT DISTINCT feature, lower(hex(encode(feature))) AS digits FROM counted),
        hashed AS MATERIALIZED (
            SELECT feature, xor(list_reduce(
                [4294967295::BIGINT] || list_transform(range(length(digits) // 2),
                    lambda i: 16 * (instr('0123456789abcdef', digits[2 * i + 1]) - 1) + instr('0123456789abcdef', digits[2 * i + 2]) - 1),
                lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM bytes, crc_table
        ),
        placed AS MATERIALIZED (SELECT kind, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY kind, id, bucket),
        totals AS (
            SELECT b.bucket, coalesce(sum(n) FILTER (kind = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 't'), 0)::DOUBLE AS t
            FROM range(10000) AS b(bucket) LEFT JOIN placed USING (bucket) GROUP BY b.bucket
        ),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM totals
        ),
        weighed AS (
            SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
            FROM placed JOIN gains USING (bucket) WHERE kind = 's' GROUP BY id
        ),
        scored AS (
            SELECT c.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || c.id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM cut c LEFT JOIN weighed USING (id) WHERE kind = 's'
        ),
        ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 5 * count(*) OVER () // 100 AS most
            FROM scored WHERE n_words >= 20
        )
        SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
    """,
    "op13_vector_codes": _vector_codes_sql(),
    "op6_lines": r"""
        WITH lines AS (
            SELECT doc_id, pos, line,
                translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (
                SELECT doc_id, unnest(of) AS line, unnest(range(len(of))) AS pos
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS of FROM documents)
            )
        ),
        frequent AS (
            SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ),
        marked AS (
            SELECT l.*, f.key IS NOT NULL AND l.doc_id < f.keeper AS dropped FROM lines l LEFT JOIN frequent f USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op8_impact": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 10
    """,
}
