import hashlib
import math

import numpy as np
import pytest

from segeval.llm.vector_codes import Slices, compress_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, of int"


def plain(rows, parts=4, entries=256, rounds=4):
    """vec_id: (code, error, label_error, digest) in Python integers, for distinct ids."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(members[n]) for col in zip(*members[n])] if n in members else e for n, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{n:02x}" for _, n in f), e, total[label], digest) for (i, _, label), f, e in zip(kept, found, errors)}


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], SCHEMA).repartition(3)


def results(df):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()}


def vectors(count, width, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 9] + spread * rng.normal(size=width)], None if i % 5 == 0 else int(i % 3)) for i in range(count)]


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_nearest_is_exact_and_ties_go_to_the_lower_entry(spread):
    rng = np.random.default_rng(1)
    book = np.round(1000 * rng.normal(size=(200, 8))).astype(np.int64)
    book[150] = book[20]
    rows = np.concatenate([book[rng.integers(0, 200, 3000)] + np.round(1000 * spread * rng.normal(size=(3000, 8))).astype(np.int64), book, np.zeros((1, 8), np.int64)])
    codes, squares = Slices(book).nearest(rows)
    all_squares = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
    assert (codes == all_squares.argmin(axis=1)).all() and (squares == all_squares.min(axis=1)).all()
    wide = Slices(book.astype(object)).nearest(rows[:50].astype(object))
    assert wide[0].tolist() == codes[:50].tolist() and wide[1].tolist() == squares[:50].tolist()


def test_masks_leave_out_far_entries():
    rng = np.random.default_rng(2)
    book = np.round(1000 * rng.normal(size=(256, 8))).astype(np.int64)
    rows = book[rng.integers(0, 256, 500)] + rng.integers(-20, 20, (500, 8))
    one = Slices(book)
    exact = ((rows[:, None] - book[None]) ** 2).sum(axis=2).min(axis=1)
    assert one.candidates(rows, np.sqrt(exact).astype(np.int64) + 1).sum(axis=1).mean() < 2
    none = one.candidates(np.full((1, 8), 10**6), np.array([5]))
    assert none.sum() == 0 and none.shape == (1, 256)


@pytest.mark.parametrize("count, width", [(600, 16), (40, 10), (1, 4), (300, 3)])
def test_result_is_the_plain_one(spark, count, width):
    rows = vectors(count, width)
    assert results(compress_vectors(table(spark, rows))) == plain(rows)


def test_odd_vectors(spark):
    rows = vectors(30, 8) + [
        (100, None, 1), (101, [None] * 8, 1), (102, [float("nan")] + [0.0] * 7, 1), (103, [float("inf")] * 8, 1),
        (104, [], 1), (105, [1.0, 2.0], 2), (None, [0.5] * 8, None), (106, [0.25] * 8, None), (107, [0.25] * 8, None),
    ]
    assert results(compress_vectors(table(spark, rows))) == plain(rows)


def test_large_components_are_exact(spark):
    rows = vectors(20, 8) + [(50, [1e6, -1e6] * 4, 1), (51, [3e7] * 8, 1), (52, [3e7] * 8, 1), (53, [-4e5] * 8, 2)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = plain(rows, entries=2)
    assert max(e for _, e, _, _ in want.values()) > 1 << 53
    assert results(compress_vectors(table(spark, rows), entries=2)) == want


def test_an_error_beyond_a_long_is_reported(spark):
    rows = [(0, [0.0] * 4, 1), (1, [1e15] * 4, 1)]
    with pytest.raises(Exception, match="does not fit a long"):
        compress_vectors(table(spark, rows), entries=1).collect()


def test_empty_tables_and_copies(spark):
    assert compress_vectors(table(spark, [])).collect() == []
    assert compress_vectors(table(spark, [(1, None, 1)])).collect() == []
    copies = [(3, [0.5, 0.25, 0.125, 1.0], 7)] * 50
    found = compress_vectors(table(spark, copies)).collect()
    assert len(found) == 50 and {(r["code"], r["error"], r["label_error"]) for r in found} == {("00000000", 0, 0)}
