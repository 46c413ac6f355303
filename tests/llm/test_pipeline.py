"""The pipeline's stages against brute force, each on its own input, and the queries against their SQL."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segeval.llm import queries, shingles, simhash, stages
from segeval.llm.mixing import Mix, mix_documents
from segeval.llm.shingles import similarity
from tests.llm import brute
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages_keep_columns_and_rows(spark, odd_docs, odd_rows):
    left = stages.without_repeated_lines(odd_docs)
    assert left.schema.names == odd_docs.schema.names
    kept = brute.dedup_lines([(i, t) for i, t, _ in odd_rows])
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == {i: (k, len(k)) for i, (_, _, k) in kept.items()}
    one = stages.one_of_each_group(odd_docs)
    assert one.schema.names == odd_docs.schema.names
    least = {c for _, _, c in brute.components([(i, brute.simhash(t)) for i, t, _ in odd_rows])}
    assert sorted(map(str, (r.doc_id for r in one.collect()))) == sorted(map(str, least))


def test_near_duplicates_with_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d")] * 3 + [(2, "a b c d"), (2, "p q r s t"), (3, None), (None, ""), (None, "u v w")], "doc_id long, text string")
    kept = [tuple(r) for r in stages.one_of_each_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d"), (2, "p q r s t"), (3, None), (None, "u v w")], key=str)


def test_near_duplicates_share_five_word_shingles(spark):
    rng = random.Random(5)
    rows, copies = [], {}
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append((1000 * i, " ".join(words)))
        # One changed word takes 5 of 96 shingles: 91 of 101, three far apart 81 of 111.
        for n in range(1, 4):
            changed = list(words)
            for at in (20, 50, 80)[:n]:
                changed[at] = f"new{n}"
            rows.append((1000 * i + n, " ".join(changed)))
            copies[1000 * i + n] = similarity(rows[-1][1], rows[-1 - n][1])
    assert {round(c, 2) for c in copies.values()} == {0.9, 0.81, 0.73}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in stages.one_of_each_group(docs).collect()}
    assert kept == {i for i, _ in rows if copies.get(i, 0) < 0.8}


def test_near_duplicates_meet_by_covering_hashing(spark, monkeypatch):
    monkeypatch.setattr(shingles, "bands", lambda hashes: [])
    rng = random.Random(7)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
        changed = [*words[:1000], "new", *words[1001:]]
        near = [simhash.majority(shingles._hashes(shingles._words(" ".join(w)), shingles.WORDS)) for w in (words, changed)]
        rows += [(10 * i, " ".join(words), True)] + [(10 * i + 1, " ".join(changed), (near[0] ^ near[1]).bit_count() > simhash.RADIUS)]
    rows += [(500 + i, text, i == 0 or "x" in text) for i, text in enumerate(["", " ", "x"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, apart boolean")
    assert sum(not apart for _, _, apart in rows) > 6
    assert {r.doc_id for r in stages.one_of_each_group(docs).collect()} == {i for i, _, apart in rows if apart}


def test_mix_repeats_documents(spark, odd_docs, odd_rows):
    rows = [(i, prose(i, 20), "ab"[i % 2]) for i in range(60)] + [(7, prose(7, 20), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(stages.mixed(docs))
    goals = brute.mix_targets(collections.Counter({s: 20 * sum(r[2] == s for r in rows) for s in "ab"}))
    for source in "ab":
        taken = sum(20 * n for (_, _, s), n in got.items() if s == source)
        assert abs(taken - goals[source]) <= 20
    assert set(got) <= set(map(tuple, rows)) and max(got.values()) <= 4
    assert stages.mixed(odd_docs).schema.names == odd_docs.schema.names


@pytest.mark.parametrize("rows_a_piece", [50_000, 2])
def test_mix_goes_by_shard_and_place(spark, monkeypatch, rows_a_piece):
    monkeypatch.setattr(stages, "PIECE_ROWS", rows_a_piece)
    docs = spark.createDataFrame([(i, prose(i, 20), "ab"[i % 2]) for i in range(90)], "doc_id long, text string, source string")
    once = Mix(share=0.9, most=1.0, levels=2)
    # Each document is taken once at most, so that it has one place.
    places = {}
    for r in mix_documents(stages._marked(docs), ["doc_id", stages._MARK], once).collect():
        for d in r.draws:
            if 2 * d.words >= r["size"]:
                places[r.doc_id] = (d.shard, d.place)
    got = stages.mixed(docs, once).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.doc_id for r in got) == sorted(places)
    by_part = collections.defaultdict(list)
    for r in got:
        by_part[r.part].append(places[r.doc_id])
    assert all(found == sorted(found) for found in by_part.values())
    assert len({shard for shard, _ in places.values()}) == 4


def test_quality_rejects_junk_only(spark, odd_docs):
    docs = spark.createDataFrame([(i, prose(i) if i % 4 else "%%% " * 40 + str(i)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    kept = {r.doc_id for r in stages.good_documents(docs, labels).collect()}
    assert kept == {i for i in range(200) if i % 4}
    assert stages.good_documents(odd_docs, labels).schema.names == odd_docs.schema.names


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for step in (lambda d: stages.good_documents(d, labels), stages.without_repeated_lines, stages.one_of_each_group, stages.mixed):
        assert step(no_docs).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "t " * i, "s", i, i, "k") for i in range(4)], "doc_id long, text string, source string, n_lines long, taken int, kept string")
    for step in (stages.without_repeated_lines, stages.one_of_each_group, stages.mixed):
        assert step(docs).schema.names == docs.schema.names
        step(docs).collect()


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    by_bin = collections.defaultdict(list)
    for r in pieces:
        by_bin[r.sequence_id].append((r.offset, r.length))
    for found in by_bin.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in pieces}
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "packing"]


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in cursor.fetchall())
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
