import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from segeval.llm import queries
from segeval.llm.flow import min_cost_transfers
from segeval.llm.resharding import carry_out, plan_blocks, plan_moves, reshard, rewrite_shards


@pytest.mark.parametrize("seed", range(30))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    old, new = rng.randint(1, 3), rng.randint(1, 3)
    sizes = [rng.randint(0, 4) for _ in range(old)]
    capacities = [rng.randint(0, 4) for _ in range(new)]
    capacities[0] += max(0, sum(sizes) - sum(capacities))
    cost = [[rng.randint(0, 5) for _ in range(new)] for _ in range(old)]
    got = min_cost_transfers(sizes, capacities, cost)
    assert [sum(f for (i, _), f in got.items() if i == k) for k in range(old)] == sizes
    assert all(sum(f for (_, j), f in got.items() if j == k) <= c for k, c in enumerate(capacities))
    units = [i for i, s in enumerate(sizes) for _ in range(s)]
    plans = itertools.product(range(new), repeat=min(len(units), 8))
    if len(units) <= 8:
        best = min(sum(cost[i][j] for i, j in zip(units, p)) for p in plans if all(p.count(k) <= c for k, c in enumerate(capacities)))
        assert sum(cost[i][j] * f for (i, j), f in got.items()) == best


def test_too_small():
    with pytest.raises(ValueError):
        min_cost_transfers([5], [2, 2], [[0, 1]])


def test_blocks_that_need_not_move_stay():
    blocks = [(0, b, 10) for b in range(6)] + [(1, b, 10) for b in range(2)]
    placed = plan_blocks(blocks, [40, 40])
    assert sum(placed[0, b] == 1 for b in range(6)) == 2 and all(placed[1, b] == 1 for b in range(2))


def check_shards(rows, shards, largest):
    sizes = {s: 0 for s in range(shards)}
    slots = {s: [] for s in range(shards)}
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_odd_rows(odd_docs, odd_rows, no_docs):
    old = F.pmod(F.xxhash64("source"), F.lit(5))
    rows = reshard(odd_docs, ["doc_id"], old, shards=3).collect()
    by_id = {r.doc_id: r for r in rows}
    for i, t, _ in odd_rows:
        raw = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    check_shards(rows, 3, max(r.size for r in rows))
    assert reshard(no_docs, ["doc_id"], old).collect() == []
    nowhere = reshard(odd_docs, ["doc_id"], F.lit(None).cast("int"), shards=2).collect()
    assert len(nowhere) == len(odd_rows)


def test_even_shards_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = reshard(docs, ["doc_id"], F.pmod(F.xxhash64("source"), F.lit(32))).collect()
    check_shards(rows, 40, max(r.size for r in rows))


def test_rewrite_leaves_other_shards_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (50 if i < 40 else 10), i % 4) for i in range(80)], "doc_id long, text string, at int")
    assigned = reshard(docs, ["doc_id"], F.col("at"), shards=4, capacities=[400, 1000, 1400, 920]).cache()
    path = str(tmp_path / "out")
    rewrite_shards(docs.select("doc_id", "text"), assigned, ["doc_id"], path)
    written = {(r.doc_id, r["shard"], r.slot) for r in spark.read.parquet(path).collect()}
    rows = assigned.collect()
    affected = {s for r in rows if r.old_shard != r["shard"] for s in (r.old_shard, r["shard"])}
    assert written == {(r.doc_id, r["shard"], r.slot) for r in rows if r["shard"] in affected}


def test_rewrite_keeps_null_keys_and_repeated_rows(spark, tmp_path):
    rows = [(i if i % 5 else None, f"text {i % 7}", ["a", "b", None][i % 3]) for i in range(60)] + [(7, "again", None)] * 3 + [(None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = ["doc_id", "source"]
    # All rows come from one shard, so that each shard gains or loses some.
    assigned = reshard(docs, keys, F.lit(0), shards=3)
    path = str(tmp_path / "out")
    rewrite_shards(docs, assigned, keys, path)
    written = spark.read.parquet(path).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in written), key=str) == sorted(rows, key=str)
    places = {(r["shard"], r.slot): (r.doc_id, r.source, r.text_crc32) for r in assigned.collect()}
    assert {(r["shard"], r.slot): (r.doc_id, r.source, zlib.crc32((r.text or "").encode())) for r in written} == places


def test_carried_out_rows_are_those_of_the_shards(spark, tmp_path):
    rows = [(i if i % 5 else None, f"text {i}" if i % 6 else None, ["a", None][i % 2], i % 4) for i in range(80)] + [(7, "again", None, 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at int")
    keys = ["doc_id", "source"]
    # The last shard keeps all it has.
    total = sum(len(t or "") + 16 for _, t, _, _ in rows)
    last = sum(len(t or "") + 16 for _, t, _, at in rows if at == 3)
    capacities = [200, 500, total - last - 700, last]
    moves = plan_moves(docs, keys, F.col("at"), 4, capacities)
    path = str(tmp_path / "out")
    got = sorted(map(tuple, carry_out(docs, moves, path).collect()), key=str)
    assert got == sorted(map(tuple, reshard(docs, keys, F.col("at"), 4, capacities).collect()), key=str)
    assert moves.affected == [0, 1, 2]
    written = spark.read.parquet(path)
    assert {r["shard"] for r in written.select("shard").distinct().collect()} == {0, 1, 2}
    left = [r for r in rows if r[3] == 3]
    both = [(r.doc_id, r.text, r.source, r.at) for r in written.collect()] + left
    assert sorted(both, key=str) == sorted(rows, key=str)


def test_query_reads_written_shards(spark):
    df = queries.op7_resharding(spark, "/root/testdata/sf0.001")
    assert any("/shards-" in f for f in df.inputFiles())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert df.count() == docs.count()


def test_clashing_columns(spark, tmp_path):
    rows = [(i, f"text {i}" * (i % 7), i % 4, -i, f"s{i}", 1, 2.5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot long, new_shard string, size int, old_shard double")
    moves = plan_moves(docs, ["doc_id"], F.col("shard"), 5)
    path = str(tmp_path / "out")
    got = sorted(map(tuple, carry_out(docs, moves, path).select("doc_id", "old_shard", "shard", "slot").collect()))
    assert got == sorted(map(tuple, reshard(docs, ["doc_id"], F.col("shard"), 5).select("doc_id", "old_shard", "shard", "slot").collect()))
    assert [r[:2] for r in got] == [(i, i % 4) for i in range(60)]
    written = spark.read.parquet(path)
    assert sorted(map(tuple, written.select("doc_id", "shard", "slot", "new_shard", "size").collect())) <= sorted((r[0], r[2], r[3], r[4], r[5]) for r in rows)
    assert {"new_new_shard", "new_slot"} <= set(written.columns)


def test_copies_of_a_row_spread(spark, tmp_path):
    rows = [(i, f"text {i} " * 20, "a") for i in range(1500)] + [(5, "the same text " * 15, "b")] * 1000 + [(None, None, None)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    moves = plan_moves(docs, ["doc_id", "source"], F.pmod(F.xxhash64("source"), F.lit(32)))
    assert moves.split and moves.split[1].count() == 1500
    path = str(tmp_path / "out")
    got = carry_out(docs, moves, path).collect()
    assert sorted(((r.doc_id, r.source, r.text_crc32) for r in got), key=str) == sorted(((i, s, zlib.crc32((t or "").encode())) for i, t, s in rows), key=str)
    check_shards(got, 40, max(r.size for r in got))
    written = sorted(((r.doc_id, r.text, r.source) for r in spark.read.parquet(path).collect()), key=str)
    assert written == sorted(rows, key=str) or len(moves.affected) < 40


def test_files_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr("segeval.llm.resharding.FILE_BYTES", 5_000)
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "doc_id long, text string")
    table = plan_moves(docs, ["doc_id"], F.lit(0), 2).table
    sizes = {}
    for r in table.collect():
        sizes.setdefault(r["__shard"], set()).add(r["__range"])
    assert all(files == set(range(len(files))) and len(files) >= 8 for files in sizes.values())
    rows = reshard(docs, ["doc_id"], F.lit(0), shards=2).collect()
    check_shards(rows, 2, 1016)
