import collections

import pytest
from pyspark.sql import functions as F

from segeval.llm.mixing import Mix, mix_documents, split_quotas, targets
from tests.llm import brute


@pytest.mark.parametrize(
    "sizes",
    [{"a": 10, "b": 20, None: 30}, {"a": 1, "b": 1000, "c": 5, "d": 0}, {"x": 7}, {f"s{i}": (i * 37) % 11 * 100 for i in range(20)}],
)
def test_targets_stop_and_share_again(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(rows, Mix()).collect()}
    assert got == pytest.approx(brute.mix_targets(sizes))


def test_quotas_add_up_and_ranges_are_disjoint(spark):
    mix = Mix(levels=3)
    quotas = spark.createDataFrame([("a", 100), ("b", 13), (None, 1), ("c", 0)], "source string, blocks int")
    rows = split_quotas(quotas, mix).collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append((r["first"], r.past))
    for source, blocks in (("a", 100), ("b", 13), (None, 1)):
        ranges = sorted(by_source[source])
        assert ranges[0][0] == 0 and ranges[-1][1] == blocks
        assert all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    shards = collections.Counter()
    for r in rows:
        shards[r.shard] += r.past - r["first"]
    assert max(shards.values()) - min(shards.values()) <= 1 and sum(shards.values()) == 114


def test_quotas_are_hypergeometric_on_average(spark):
    """A source with a third of the urn gives each half a third of its blocks, with the spread of drawing without replacement."""
    halves = []
    for seed in range(40):
        quotas = spark.createDataFrame([("a", 20), ("b", 40)], "source string, blocks int")
        rows = split_quotas(quotas, Mix(levels=1, seed=seed)).where("source = 'a' and shard = 0").collect()
        halves.append(rows[0].past - rows[0]["first"] if rows else 0)
    mean = sum(halves) / len(halves)
    variance = sum((h - mean) ** 2 for h in halves) / len(halves)
    assert mean == pytest.approx(10, abs=1.2) and 1 < variance < 8


def test_mix_of_odd_rows(odd_docs, odd_rows):
    mixed = mix_documents(odd_docs, ["doc_id"])
    got = {r.doc_id: r for r in mixed.collect()}
    sizes = collections.Counter({s: 0 for _, _, s in odd_rows})
    for i, t, s in odd_rows:
        size = len(brute.WORD.findall(t or ""))
        sizes[s] += size
        assert got[i].size == size and got[i].taken <= 2 * size
        assert got[i].taken == sum(d["words"] for d in got[i].draws)
    want = brute.mix_targets(sizes)
    for source in sizes:
        rows = [r for r in got.values() if r.source == source]
        assert sum(r.taken for r in rows) == pytest.approx(want[source], abs=1)
        assert all(r.target == pytest.approx(want[source]) and r.source_size == sizes[source] for r in rows)
    again = {r.doc_id: r for r in mix_documents(odd_docs.repartition(5), ["doc_id"]).collect()}
    assert again == got


def test_shards_are_even(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    rows = mix_documents(docs, ["doc_id"]).select(F.explode("draws").alias("d")).groupBy("d.shard").agg(F.sum("d.words").alias("words")).collect()
    words = [r.words for r in rows]
    assert len(rows) == 16 and max(words) - min(words) < 0.05 * sum(words) / 16


def test_repeated_rows_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 4, "doc_id long, text string, source string")
    assert sum(r.taken for r in mix_documents(docs, ["doc_id"]).collect()) == 18
    assert mix_documents(no_docs, ["doc_id"]).collect() == []
