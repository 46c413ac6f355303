import random

import public_tokenizers
import pytest

from segeval.llm.packing import RoomTree, cut, pack, plan_bins
from segeval.llm.tokens import WordEncoder
from tests.llm import brute
from tests.llm.conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tree_finds_the_tightest():
    rng = random.Random(0)
    tree, held = RoomTree(50), []
    for _ in range(400):
        if held and rng.random() < 0.5:
            tree.add(held.pop(rng.randrange(len(held))), -1)
        else:
            held.append(rng.randint(0, 50))
            tree.add(held[-1], 1)
        least = rng.randint(0, 50)
        assert tree.tightest(least) == min((r for r in held if r >= least), default=None)


def filled(counts, plan, room):
    bins = {}
    for length in counts:
        ranges = sorted(p[1:] for p in plan if p[0] == length)
        assert ranges[0][0] == 0 and ranges[-1][1] == counts[length]
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    for length, first, past, start, offset in plan:
        for i in range(past - first):
            bins.setdefault(start + i, []).append((offset, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= room
    return bins


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    room = rng.choice([7, 16, 100])
    counts = {rng.randint(1, room): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    bins = filled(counts, plan_bins(counts, room), room)
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) == brute.best_fit_decreasing([x for x, n in counts.items() for _ in range(n)], room)


def test_cut():
    assert cut(1) == [(0, 1)] and cut(1024) == [(0, 1024)] and cut(2048) == [(0, 1024), (1024, 1024)]
    assert cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_encoder_equals_the_library(odd_rows, monkeypatch):
    from segeval.llm import tokens

    odd = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a\n b", "a\tb", "a\xa0b", "don't we'll", "x<|endoftext|>y", "\x1c", "a᠎b c", "é è\nê", "１２ ３"]
    texts = odd + [t or "" for _, t, _ in odd_rows] + [prose(i, 300) for i in range(20)]
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    monkeypatch.setattr(tokens, "PASSING_WORDS", 10)
    encoder = WordEncoder(PATH)
    for _ in range(2):
        want = brute.token_ids(texts, PATH)
        assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] + [2] for x in encoder.encode(texts)] == want


def test_pack_odd_rows(odd_docs, odd_rows, no_docs):
    rows = pack(odd_docs, ["doc_id"], PATH).collect()
    ids = dict(zip([i for i, _, _ in odd_rows], brute.token_ids([t or "" for _, t, _ in odd_rows], PATH)))
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [(r.start, r.length) for r in pieces] == cut(len(ids[i]))
    assert set(by_doc) == set(ids)
    for pieces in by_bin.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_bin) == brute.best_fit_decreasing([r.length for r in rows], 1024)
    assert pack(no_docs, ["doc_id"], PATH).collect() == []


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text")] * 5, "doc_id long, text string")
    rows = pack(docs, ["doc_id"], PATH).collect()
    assert len(rows) == 5 and len({(r.sequence_id, r.offset) for r in rows}) == 5
