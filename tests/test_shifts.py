"""Edit rate with moves: worked cases, and a plain search over a full edit table."""

import random

import pytest
from pyspark.sql import functions as F

from segeval.functions.sequence import edit_distance
from segeval.functions.shifts import FARTHEST, LONGEST_RUN, MOST_TRIED, _Table, shift_edits
from segeval.operators import lexical, scoring

WORKED = [
    # The published example: one move, two words exchanged, one left out.
    ("this week the saudis denied information published in the new york times", "saudi arabia denied this week information published in the american new york times", 4),
    ("a b c d", "a b c d", 0),
    ("c d a b", "a b c d", 1),
    ("b a d c", "a b c d", 2),
    ("d c b a", "a b c d", 3),
    ("x a b c", "a b c", 1),
    ("a c", "a b c", 1),
    ("", "a b", 2),
    ("a b", "", 2),
    ("p q r s t", "a b c d e", 5),
    ("the cat sat on the mat today", "today the cat sat on the mat", 1),
]


@pytest.mark.parametrize("hyp, ref, edits", WORKED)
def test_worked(hyp, ref, edits):
    assert shift_edits(hyp.split(), ref.split()) == edits


def plain_table(h, r):
    """Distances and the step into every cell: exchange first, then a word of h left out, then one of r."""
    cost = [[0] * (len(r) + 1) for _ in range(len(h) + 1)]
    step = [["r"] * (len(r) + 1) for _ in range(len(h) + 1)]
    for i in range(len(h) + 1):
        for j in range(len(r) + 1):
            ways = []
            if i and j:
                ways.append((cost[i - 1][j - 1] + (h[i - 1] != r[j - 1]), 0, "x"))
            if i:
                ways.append((cost[i - 1][j] + 1, 1, "h"))
            if j:
                ways.append((cost[i][j - 1] + 1, 2, "r"))
            if ways:
                cost[i][j], _, step[i][j] = min(ways)
    return cost, step


def plain_alignment(h, r):
    _, step = plain_table(h, r)
    path, i, j = [], len(h), len(r)
    while i or j:
        path.append(step[i][j])
        i, j = i - (path[-1] != "r"), j - (path[-1] != "h")
    at, bad_h, bad_r, i, j = {}, {}, {}, -1, -1
    for s in reversed(path):
        i, j = i + (s != "r"), j + (s != "h")
        if s != "h":
            at[j] = i
        if s == "x":
            bad_h[i] = bad_r[j] = h[i] != r[j]
        elif s == "h":
            bad_h[i] = True
        else:
            bad_r[j] = True
    return at, bad_h, bad_r


def plain_edits(h, r):
    moves = tried = 0
    while h and r:
        at, bad_h, bad_r = plain_alignment(h, r)
        now = plain_table(h, r)[0][-1][-1]
        options = []
        for a in range(len(h)):
            for b in range(len(r)):
                for n in range(1, LONGEST_RUN + 1):
                    if tried >= MOST_TRIED or abs(a - b) > FARTHEST or a + n > len(h) or b + n > len(r) or h[a : a + n] != r[b : b + n]:
                        break
                    if not any(bad_h[a + k] for k in range(n)) or not any(bad_r[b + k] for k in range(n)) or a <= at[b] < a + n:
                        continue
                    last = None
                    for k in range(-1, n):
                        to = 0 if b + k == -1 else at[b + k] + 1
                        if to == last:
                            continue
                        last = to
                        if to < a:
                            new = h[:to] + h[a : a + n] + h[to:a] + h[a + n :]
                        elif to > a + n:
                            new = h[:a] + h[a + n : to] + h[a : a + n] + h[to:]
                        else:
                            new = h[:a] + h[a + n : n + to] + h[a : a + n] + h[n + to :]
                        tried += 1
                        options.append((plain_table(new, r)[0][-1][-1], -n, a, to, new))
        if tried >= MOST_TRIED or not options or min(options)[0] >= now:
            return moves + now
        h, moves = min(options)[4], moves + 1
    return moves + max(len(h), len(r))


@pytest.mark.parametrize("seed", range(150))
def test_equals_plain_search(seed):
    rng = random.Random(seed)
    words = "abcdefghijklmnop"[: rng.choice([2, 5, 16])]
    r = [rng.choice(words) for _ in range(rng.randint(0, 14))]
    h = r[:]
    for _ in range(rng.randint(0, 3)):
        a, n = rng.randint(0, len(h)), rng.randint(1, 5)
        block, rest = h[a : a + n], h[:a] + h[a + n :]
        to = rng.randint(0, len(rest))
        h = rest[:to] + block + rest[to:]
    h = [rng.choice(words) if rng.random() < 0.15 else w for w in h if rng.random() < 0.9]
    assert shift_edits(h, r) == plain_edits(h, r) <= edit_distance(h, r)


@pytest.mark.parametrize("seed", range(20))
def test_alignment_equals_plain_table(seed):
    rng = random.Random(seed)
    h, r = ([rng.choice("abcd") for _ in range(rng.randint(1, 20))] for _ in range(2))
    table = _Table(r)
    table.fill(h)
    at, wrong, wrong_reference = table.align()
    want_at, bad_h, bad_r = plain_alignment(h, r)
    assert (at, wrong, wrong_reference) == ([want_at[j] for j in range(len(r))], [bad_h[i] for i in range(len(h))], [bad_r[j] for j in range(len(r))])


def test_many_moves_end():
    h, r = ["a", "b"] * 300, ["b", "a", "a"] * 200
    assert 0 < shift_edits(h, r) <= edit_distance(h, r)


def test_columns(spark):
    rows = [(1, "C d A b", "a b c d"), (2, "", ""), (3, "x", ""), (4, None, "a"), (5, "a", None), (6, "  ", "a b"), (7, "a b c d e", "z")]
    df = spark.createDataFrame(rows, "row_id int, h string, r string")
    got = {r.row_id: (r.rate, r.score) for r in df.select("row_id", lexical.translation_edit_rate(F.col("h"), F.col("r")).alias("rate"), lexical.translation_edit_score(F.col("h"), F.col("r")).alias("score")).collect()}
    assert got == {1: (25.0, 0.75), 2: (0.0, 1.0), 3: (100.0, 0.0), 4: (None, None), 5: (None, None), 6: (100.0, 0.0), 7: (500.0, 0.0)}
    texts = df.select(F.col("h").alias("targetText"), F.col("r").alias("referenceText"), F.col("h").alias("sourceText"), "row_id")
    assert scoring.add_scores(texts, ["TER"]).where("row_id = 1").first().ter_score == 0.75
