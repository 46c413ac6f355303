import numpy as np
import pytest

from segeval.llm import syncmers
from tests.llm import brute
from tests.llm.conftest import prose


def test_anchors_are_closed_syncmers():
    text = prose(5)
    k, s = syncmers.K, syncmers.S
    found, _ = syncmers.anchors(text)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    inner = syncmers._hashes(points, None, s).tolist()
    want = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    assert found.tolist() == want


def test_anchors_do_not_depend_on_context():
    text = prose(6)
    alone = {(p + 9, h) for p, h in zip(*map(np.ndarray.tolist, syncmers.anchors(text)))}
    assert alone <= set(zip(*map(np.ndarray.tolist, syncmers.anchors("preamble " + text + " and more"))))


def test_likeness_estimates_jaccard():
    left, right = prose(7, 400), prose(7, 400)[:1300] + prose(8, 200)
    a, b = (set(syncmers.anchors(t)[1].tolist()) for t in (left, right))
    assert syncmers.likeness(*map(syncmers.sketch, (left, right))) == pytest.approx(len(a & b) / len(a | b), abs=0.12)
    empty = syncmers.sketch("")
    assert syncmers.likeness(empty, empty) == 1 and syncmers.likeness(empty, syncmers.sketch("a")) == 0


def test_edits_follow_descending_ids(odd_docs, odd_rows):
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(odd_docs).collect()}
    texts = brute.edited([(i, t) for i, t, _ in odd_rows])
    assert len(got) == len(odd_rows)
    by_text = {}
    for i, t, _ in odd_rows:
        row = got[i]
        assert row.n_chars == len(t or "") and row.edited_sha256 == brute.sha(texts[i])
        assert row.fingerprint == syncmers.fingerprint(syncmers.sketch(t or ""))
        assert row.edited_fingerprint == syncmers.fingerprint(syncmers.sketch(texts[i]))
        assert row.near_edited == syncmers.likeness(syncmers.sketch(t or ""), syncmers.sketch(texts[i]))
        assert by_text.setdefault(t or "", row.fingerprint) == row.fingerprint
    order = sorted(got, key=brute.order_key)
    following = dict(zip(order, [*order[1:], order[0]]))
    plain = {i: syncmers.sketch(t or "") for i, t, _ in odd_rows}
    assert all(got[i].near_next == syncmers.likeness(plain[i], plain[following[i]]) for i in got)


@pytest.mark.parametrize("ids", [[None, None], [4], [7, 7, 7], [2**62, 2**62 + 1, None]])
def test_ties_and_missing_ids(spark, ids):
    docs = spark.createDataFrame([(i, prose(n)) for n, i in enumerate(ids)], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in syncmers.fingerprint_edits(docs).collect()))) == sorted(map(str, ids))


def test_no_rows(no_docs):
    assert syncmers.fingerprint_edits(no_docs).collect() == []


@pytest.mark.parametrize("first", [2**53, 2**62, -(2**62)])
def test_large_ids_are_told_apart(spark, first):
    rows = [(first + i, prose(i, 30)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(docs).collect()}
    texts = brute.edited(rows)
    plain = {i: syncmers.sketch(t) for i, t in rows}
    order = sorted(plain, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]]))
    assert set(got) == set(texts)
    for i in texts:
        assert got[i].edited_sha256 == brute.sha(texts[i])
        assert got[i].near_next == syncmers.likeness(plain[i], plain[following[i]])
