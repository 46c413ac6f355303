import itertools
import random

import pytest

from segeval.llm import simhash
from segeval.llm.components import components
from tests.llm import brute


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    full = (1 << 64) - 1
    assert len(masks) == 7
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        assert any(not m & ((1 << i) | (1 << j)) for m in masks)
    assert all(0 < m < full for m in masks)


def test_fingerprint_of_long_text_in_blocks(monkeypatch, odd_rows):
    whole = [simhash.fingerprint(t or "") for _, t, _ in odd_rows]
    assert whole == [brute.simhash(t) for _, t, _ in odd_rows]
    monkeypatch.setattr(simhash, "_BLOCK", 5)
    assert [simhash.fingerprint(t or "") for _, t, _ in odd_rows] == whole


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_links_reach_what_brute_force_reaches(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(40):  # chains and stars around random centres
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            prints.append(at)
            for _ in range(rng.randrange(4)):
                at ^= 1 << rng.randrange(64)
    prints += [0, 1, 3, 7, 1 << 63, (1 << 64) - 1]
    want = brute.components([(signed(p), p) for p in sorted(set(prints))])
    distinct = spark.createDataFrame([(signed(p),) for p in set(prints)], "bits long")
    found = {r.node: r.root for r in components(simhash.near_links(distinct)).collect()}
    by_root, by_want = {}, {}
    for d, _, least in want:
        by_want.setdefault(least, set()).add(d)
        by_root.setdefault(found.get(d, d), set()).add(d)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000)], "a long, b long")
    rows = components(links).collect()
    assert len(rows) == 301 and len({r.root for r in rows}) == 1


@pytest.mark.parametrize("parts", [1, 6])
def test_components_of_odd_rows(odd_docs, odd_rows, parts):
    rows = simhash.near_duplicates(odd_docs.repartition(parts), ["doc_id"], "doc_id").collect()
    got = sorted(((r.doc_id, r.bits, r.component_id) for r in rows), key=str)
    want = brute.components([(i, brute.simhash(t)) for i, t, _ in odd_rows])
    assert got == sorted(((d, signed(p), c) for d, p, c in want), key=str)


def test_repeated_rows_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs, ["doc_id"], "doc_id").collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(no_docs, ["doc_id"], "doc_id").collect() == []
