"""Token counts by counting each distinct pre-token once.

A piece of the vocabulary has white space at its start only and no line break, so
no merge crosses from a word to the blank after it, nor into or out of a line
break. A text's tokens are therefore those of its pre-tokens: runs of blanks with
the word after them, other runs of blanks, and runs of line breaks. Three steps:

1. distinct pre-tokens with their numbers are gathered, and the tokens of each are
   counted once;
2. a document's pre-token frequencies meet the counts. The most frequent pre-tokens,
   ``HEAD`` at most, go to every task; a pre-token beyond them has at most about
   ``2 / HEAD`` of all places, so the join on the others has no hot key;
3. products are summed by document. Ids are never kept.

Edge cases: a null or empty text has no token. Every row is counted, also copies
and rows without keys; only the columns in ``keys`` are read besides ``text``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segeval.functions.worker import held
from segeval.scratch import materialize

#: Most pre-tokens that go to every task; each has at most ``KEY`` bytes there.
HEAD = 1 << 18
KEY = 72

#: Distinct pre-tokens that a task gathers before it hands them on.
GATHERED = 200_000

#: Pre-tokens whose tokens are counted in one call.
COUNTED = 2_000

#: Rare pre-tokens of documents that a task lists before it hands them on, but for the last document's.
LISTED = 50_000

_BLANK = "▁"  # fixed value: how the model writes a blank
_PRE_TOKENS = re.compile(" *[^ \n]+| +|\n+")


def pre_tokens(text: str) -> list[str]:
    """The text in order, with the blank that the model puts before it."""
    return _PRE_TOKENS.findall(" " + text.replace(_BLANK, " ")) if text else []


class PieceCounter:
    """Numbers of tokens of pre-tokens under a SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self._model.id_to_piece(i) for i in range(self._model.get_piece_size()))
        for piece in pieces:
            plain = piece.replace(_BLANK, " ")
            if len(_PRE_TOKENS.findall(plain)) > 1 or ("\n" in plain and plain != "\n"):
                raise ValueError(f"pre-tokens cannot be counted apart: the vocabulary has the piece {piece!r}")
        # The model must read text as it is, with one blank put before it.
        if self._model.decode(self._model.encode("  a\tB ﬁ  ")) != "  a\tB ﬁ  ":
            raise ValueError("pre-tokens cannot be counted apart: the model changes texts before it cuts them")
        self._before = len(self._model.encode("\n"))

    def count(self, tokens: list[str]) -> list[int]:
        """A line break goes before each, which merges with nothing."""
        ids = self._model.encode(["\n" + t for t in tokens], num_threads=1)
        return [len(i) - self._before for i in ids]


def key_of(token: str) -> str:
    """The pre-token, or a digest of the same meaning if it is long. Pre-tokens have no line break next to a letter."""
    raw = token.encode()
    return token if len(raw) < KEY else "\n:" + hashlib.sha256(raw).hexdigest()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["token", "places"])
        found.clear()
        return rows

    for batch in batches:
        for text in batch.column("text"):
            found.update(pre_tokens(text.as_py()))
            if len(found) > GATHERED:
                yield flush()
    if found:
        yield flush()


def distinct_pre_tokens(docs: DataFrame, model: str) -> DataFrame:
    """``key, places, pieces`` of each distinct pre-token: how often it stands in the table, and its number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("pieces", model), lambda: PieceCounter(model))
        for batch in batches:
            for begin in range(0, batch.num_rows, COUNTED):
                some = batch.slice(begin, COUNTED)
                tokens = some.column("token").to_pylist()
                keys = pa.array(map(key_of, tokens), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [keys, some.column("places"), pa.array(counter.count(tokens), pa.int64())], ["key", "places", "pieces"]
                )

    texts = docs.select("text").where("text != ''")
    tokens = texts.mapInArrow(_gather, "token string, places long").groupBy("token").agg(F.sum("places").alias("places"))
    return tokens.mapInArrow(count, "key string, places long, pieces long")


def frequent(counted: DataFrame, most: int = HEAD) -> dict[str, int]:
    """``key: pieces`` of the pre-tokens with at least as many places as a power of two that leaves ``most`` or fewer."""
    level = F.floor(F.log2("places")).cast("int")
    sizes = sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return {}
    rows = counted.where(level >= least).select("key", "pieces").toArrow()
    return dict(zip(rows.column("key").to_pylist(), rows.column("pieces").to_pylist()))


def _weighed(batches: Iterator[pa.RecordBatch], pieces: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The tokens of the pre-tokens in ``pieces``, and the other pre-tokens with their numbers as ``rest``."""
    for batch in batches:
        begin, sums, ends = 0, [], [0]
        rare: list[str] = []
        numbers: list[int] = []
        for at, text in enumerate(batch.column("text"), 1):
            total = 0
            for token, n in Counter(pre_tokens(text.as_py())).items():
                one = pieces.get(token)
                if one is None:
                    key = key_of(token)
                    one = pieces.get(key)
                if one is None:
                    rare.append(key)
                    numbers.append(n)
                else:
                    total += n * one
            sums.append(total)
            ends.append(len(rare))
            # Handed on before many have gathered, whatever the number of rows that a batch brings.
            if len(rare) >= LISTED or at == batch.num_rows:
                rest = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(numbers, pa.int64())], ["key", "n"])
                kept = [batch.column(c).slice(begin, at - begin) for c in ("row", "of", "n_bytes")]
                rests = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64()), rests], ["row", "of", "n_bytes", "known", "rest"])
                begin, sums, ends, rare, numbers = at, [], [0], [], []


def token_counts(docs: DataFrame, model: str, keys: list[str], limit: int = 4096, head: int = HEAD) -> DataFrame:
    """``keys``, ``n_bytes`` of the text as UTF-8, ``n_tokens``, and whether they exceed ``limit``. Jobs run when this is called."""
    spark = docs.sparkSession
    counted = materialize(distinct_pre_tokens(docs, model), "pre-tokens")
    known = spark.sparkContext.broadcast(frequent(counted, head))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _weighed(batches, known.value)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*keys).alias("of"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    rest_of = T.StructType().add("key", "string").add("n", "long")
    schema = rows.drop("text").schema.add("known", "long").add("rest", T.ArrayType(rest_of))
    weighed = materialize(rows.mapInArrow(weigh, schema), "weighed")
    rest = weighed.select("row", F.inline("rest")).join(counted.select("key", "pieces"), "key")
    sums = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    found = weighed.drop("rest").join(sums, "row", "left").withColumn("n_tokens", n_tokens)
    return found.select("of.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
