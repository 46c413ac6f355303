"""Personal data: patterns, and terms that reveal what the patterns found.

Base entities are e-mail addresses, IP addresses, card numbers and phone numbers.
Information-theoretic sanitisation (Sanchez and Batet 2016) adds terms: the corpus
tells which terms stand near an entity, and a term ``t`` discloses the share
``PMI(t; e) / IC(e)`` of an entity ``e``, with the probabilities of ``e``, of ``t`` and
of both taken over whole documents, base entities themselves left out. Terms that
disclose at least ``Rules.disclose`` of some entity, with it in at least ``Rules.support``
documents, are marked wherever they occur; those at or above ``Rules.remove`` are to be
removed, the others generalised.

Edge cases: a null text is an empty one and has no spans. Repeated rows each count
as a document. Texts are never cut. Work is linear in their length, but for one look at a
bitmap for each entity and candidate term of a text, a few nanoseconds each.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"


@dataclass(frozen=True)
class Rules:
    """When a term reveals an entity. ``near``: code points on either side of an entity in which candidates stand; ``support``: documents with both."""

    near: int = 100
    support: int = 1
    disclose: float = 0.95
    remove: float = 0.99


#: Bits of a filter for each value it holds, and the bounds of its size: at most 16 MB are broadcast.
BITS_EACH = 256
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27

#: Weighs the checksum of a pair's term against that of its entity.
PAIR_FACTOR = 40_503

#: Terms whose counts a task holds before it passes them on.
HELD_TERMS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
# No digit goes before: a run of digits matches from its start or not at all.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, at sign and domain. The local part is the run of its characters before the sign."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            # What stands before this sign can be in no later match.
            end = at
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base entities by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(text: str, span: Span) -> str:
    """The value that a span stands for, however it is written."""
    kind, start, end = span
    value = text[start:end]
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NO_DIGIT.sub('', value)}"


def _hidden(text: str, spans: list[Span]) -> str:
    """A text with blanks in place of spans."""
    if not spans:
        return text
    parts, at = [], 0
    for _, a, b in spans:
        if b > at:
            parts += [text[at:a], " " * (b - max(a, at))]
            at = b
    return "".join([*parts, text[at:]])


def _terms(text: str, spans: list[Span]) -> set[str]:
    """Terms outside the spans, in lower case."""
    return {t.lower() for t in _TERM.findall(_hidden(text, spans))}


def contexts(text: str, spans: list[Span], near: int) -> set[tuple[str, str]]:
    """Pairs of a term and an entity near which it stands, as a whole. Terms of entities do not count."""
    found = [(*m.span(), m[0].lower()) for m in _TERM.finditer(_hidden(text, spans))]
    starts, ends = [a for a, _, _ in found], [b for _, b, _ in found]
    pairs = set()
    for span in spans:
        name = entity(text, span)
        pairs |= {(t, name) for _, _, t in found[bisect_left(starts, span[1] - near) : bisect_right(ends, span[2] + near)]}
    return pairs


def _found(near: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pair = pa.struct([("term", pa.string()), ("entity", pa.string())])
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [base_spans(t) for t in texts]
            pairs = [[{"term": t, "entity": e} for t, e in sorted(contexts(t, s, near))] if s else [] for t, s in zip(texts, spans)]
            names = [sorted({entity(t, x) for x in s}) for t, s in zip(texts, spans)]
            listed = [[{"start": a, "kind": KINDS.index(k), "end": b} for k, a, b in s] for s in spans]
            arrays = [batch.column("doc_id"), batch.column("mark"), pa.array(listed, pa.list_(span)), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pairs, pa.list_(pair))], ["doc_id", "mark", "base", "entities", "near"])

    return found


def _crc(column: Column | str) -> Column:
    return F.crc32(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"))


def hash_filter(values: DataFrame, hashed: Column) -> np.ndarray:
    """A bitmap that holds ``hashed``, a number from 0, of every row; it may let others pass. It grows with the rows up to a bound."""
    size = LEAST_BITS
    wanted = BITS_EACH * values.count()
    while size < min(wanted, MOST_BITS):
        size *= 2
    bit = hashed % size
    cell = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))
    words = values.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(cell).alias("bits")).toArrow()
    out = np.zeros(size // 32, dtype=np.uint32)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bitmap of the checksums of ``term``."""
    return hash_filter(terms, _crc("term"))


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(32 * len(bits))
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


class _Passes(dict):
    """Whether the filter lets a term pass; forgets all when it has grown large."""

    def __init__(self, bits: np.ndarray) -> None:
        self._bits = bits

    def __missing__(self, term: str) -> bool:
        if len(self) > HELD_TERMS:
            self.clear()
        at = zlib.crc32(term.encode()) % (32 * len(self._bits))
        self[term] = passes = bool(int(self._bits[at >> 5]) >> (at & 31) & 1)
        return passes


def _frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, documents`` for the given terms, over all texts. Tasks count before they shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(term_filter(terms))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Passes(shared.value)
        counts: Counter[str] = Counter()

        def packed() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["term", "documents"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(t for t in _terms(text, base_spans(text)) if passes[t])
            if len(counts) > HELD_TERMS:
                yield packed()
                counts.clear()
        yield packed()

    partial = texts.select("text").mapInArrow(counted, "term string, documents long")
    return partial.groupBy("term").agg(F.sum("documents").alias("documents")).join(terms.select("term"), "term", "left_semi")


def _together(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``term, entity, together``: documents that hold both of a given pair, wherever they stand in it.

    Every entity of a text is looked up with all its terms at once.
    """
    context = texts.sparkSession.sparkContext
    of_terms, of_pairs = context.broadcast(term_filter(pairs.select("term"))), context.broadcast(hash_filter(pairs, _crc("term") * PAIR_FACTOR + _crc("entity")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, bits = _Passes(of_terms.value), of_pairs.value
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for text in batch.column("text").to_pylist():
                if spans := base_spans(text):
                    terms = [t for t in _terms(text, spans) if passes[t]]
                    hashes = np.array([zlib.crc32(t.encode()) for t in terms], dtype=np.uint64) * np.uint64(PAIR_FACTOR)
                    for name in {entity(text, s) for s in spans}:
                        met = np.flatnonzero(_held(bits, hashes + np.uint64(zlib.crc32(name.encode()))))
                        counts.update((terms[i], name) for i in met)
            columns = [pa.array([t for t, _ in counts], pa.string()), pa.array([e for _, e in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "entity", "together"])

    partial = texts.select("text").mapInArrow(counted, "term string, entity string, together long")
    return partial.groupBy("term", "entity").agg(F.sum("together").alias("together"))


def disclosing_terms(found: DataFrame, texts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``term, entity, disclosure``: terms that reveal an entity, each with the entity it reveals most.

    Terms near an entity are candidates; what they disclose is counted over whole documents.
    """
    total = texts.count()
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("known"))
    content = F.greatest(-F.log(F.col("known") / F.lit(float(total))), F.lit(1e-12))
    entities = entities.where(F.col("known") >= rules.support).withColumn("content", content)
    # A term discloses an entity if it is in so many documents for each that holds both.
    entities = entities.withColumn("factor", F.exp((1 - rules.disclose) * F.col("content")))
    near = found.select(F.inline("near")).distinct().join(entities, "entity")
    # No pair is in more documents than its entity is.
    near = materialize(near.withColumn("most", F.col("known") * F.col("factor")), "near")
    terms = materialize(near.groupBy("term").agg(F.max("most").alias("most")), "terms")
    counted = materialize(_frequencies(texts, terms), "counted")
    candidates = materialize(near.join(counted, "term").where(F.col("documents").between(F.lit(rules.support), F.col("most"))), "candidates")
    met = candidates.join(_together(texts, candidates), ["term", "entity"])
    met = met.where((F.col("together") >= rules.support) & (F.col("documents") <= F.col("together") * F.col("factor")))
    disclosure = F.least(1 - F.log(F.col("documents") / F.col("together")) / F.col("content"), F.lit(1.0))
    best = F.max(F.struct(disclosure.alias("disclosure"), "entity")).alias("best")
    return met.groupBy("term").agg(best).select("term", "best.entity", "best.disclosure")


def _occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, mark, term, start, end`` of the given terms outside base spans."""
    shared = texts.sparkSession.sparkContext.broadcast(term_filter(terms))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Passes(shared.value)
        for batch in batches:
            rows = []
            for doc_id, mark, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")]):
                for m in _TERM.finditer(_hidden(text, base_spans(text))):
                    if passes[term := m[0].lower()]:
                        rows.append((doc_id, mark, term, *m.span()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "term", "start", "end"])

    hits = texts.mapInArrow(marked, "doc_id long, mark long, term string, start long, end long")
    return materialize(hits, "hits").join(terms.select("term", "disclosure"), "term")


def personal_spans(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``doc_id``, ``base`` and ``terms``: arrays of spans of every row.

    A base span has ``start, kind`` (position in ``KINDS``) and ``end``, a term's
    span ``start, end, term, remove``. Offsets are code points.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    schema = (
        "doc_id long, mark long, base array<struct<start: long, kind: int, end: long>>, entities array<string>, "
        "near array<struct<term: string, entity: string>>"
    )
    found = materialize(texts.mapInArrow(_found(rules.near), schema), "found")
    terms = materialize(disclosing_terms(found, texts, rules), "terms")
    hits = _occurrences(texts, terms)
    # Equal rows found the same spans; one set of them goes back to each.
    span = F.struct("start", "end", "term", (F.col("disclosure") >= rules.remove).alias("remove"))
    spans = hits.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(span)).alias("terms"))
    spans = materialize(spans.toDF("__id", "__mark", "terms"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    return found.join(spans, same, "left").select("doc_id", "base", F.coalesce("terms", F.expr("cast(array() as array<struct<start: long, end: long, term: string, remove: boolean>>)")).alias("terms"))


def span_digest(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans by kind, their digest, and all spans as text."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])

    def written(span: Column) -> Column:
        return F.concat_ws(":", F.get(names, span["kind"]), span["start"], span["end"])

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    added = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    whole = F.array_sort(F.concat("base", added))
    return found.select(
        "doc_id",
        *[number(k) for k in range(len(KINDS))],
        F.sha2(F.array_join(F.transform("base", written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(whole, written), ",").alias("spans"),
    )


def sanitise(text: str, base: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    """A text with its entities replaced by their kinds; revealing terms go or become a general word.

    Of spans that overlap, the one that starts first is replaced, at equal starts the longer one.
    """
    edits = [(a, b, f"[{k}]") for k, a, b in base]
    edits += [(a, b, "" if remove else "[name]" if text[a].isupper() else "[term]") for a, b, remove in terms]
    out, at = [], 0
    for a, b, word in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a >= at:
            out += [text[at:a], word]
            at = b
    return "".join([*out, text[at:]])
