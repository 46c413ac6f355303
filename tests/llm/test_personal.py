import hashlib
import random

import pytest

from segeval.llm import personal
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.mark.parametrize("seed", range(60))
def test_base_spans_equal_the_patterns(seed):
    rng = random.Random(seed)
    pieces = ["a", "Z9", "@", ".", "-", "+", " ", "1", "4111", "  ", "(", "é", "_x", "255", "10.0.0.1", "256", "\n", "x@y.z", "4111111111111111", "+1 555 010 9999"]
    text = "".join(rng.choice(pieces) for _ in range(120))
    assert personal.base_spans(text) == brute.base_spans(text)


def test_long_runs_take_linear_time():
    for text in ("7" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 50_000, "+1" + " " * 100_000, "1-" * 100_000):
        personal.base_spans(text)


def digests(frame):
    return sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in frame.collect()), key=str)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = digests(personal.span_digest(personal.personal_spans(odd_docs)))
    assert len(got) == len(odd_rows)
    by_id = {g[0]: g for g in got}
    for i, t, _ in odd_rows:
        spans = brute.base_spans(t)
        listed = [":".join(map(str, s)) for s in spans]
        assert by_id[i][1:5] == tuple(sum(s[0] == k for s in spans) for k in personal.KINDS)
        assert by_id[i][5] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in by_id[i][6].split(",") if s and not s.startswith("term:")] == listed
    assert personal.span_digest(personal.personal_spans(no_docs)).collect() == []


def test_revealing_terms_are_marked_everywhere(spark):
    rows = [(i, f"{prose(i, 30)} Quillon writes from quill@mail.example.com today {prose(i + 500, 30)}") for i in range(40)]
    rows += [(100, f"{prose(9, 10)} then quillon left"), (100, f"{prose(9, 10)} then quillon left")]
    rows += [(200 + i, prose(300 + i) + " today writes from here") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in personal.personal_spans(docs).collect()}
    for i in range(40):
        text = rows[i][1]
        marked = {text[s.start : s.end].lower() for s in found[i].terms}
        assert marked == {"quillon"}
    (span,) = found[100].terms
    assert rows[40][1][span.start : span.end] == "quillon"
    assert not any(found[200 + i].terms for i in range(200))
    clean = personal.sanitise(rows[0][1], [("email", s.start, s.end) for s in found[0].base], [(s.start, s.end, s.remove) for s in found[0].terms])
    assert "[email]" in clean and "quill" not in clean.lower()


def test_terms_far_from_the_entity_count_as_together(spark):
    far = " ".join(["filler"] * 60)
    rows = [(i, f"Quillon wrote {far if i % 2 else 'here'} to quill@mail.example.com") for i in range(10)]
    rows += [(100 + i, f"{prose(i)} wrote here filler to nobody") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.term for s in r.terms] for r in personal.personal_spans(docs).collect()}
    assert all(found[i] == ["quillon"] for i in range(10))
    assert not any(found[100 + i] for i in range(300))


@pytest.mark.parametrize("seed", range(40))
def test_contexts_equal_a_plain_search(seed):
    rng = random.Random(seed)
    pieces = ["word", "Other", "ab", "x@y.example", "10.0.0.1", "4111111111111111", "+1 555 010 9999", " ", " ", "é", "long" * 9, "a" * 60 + "@far.example.org"]
    text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(60))
    spans = personal.base_spans(text)
    inside = {i for _, a, b in spans for i in range(a, b)}
    hidden = "".join(" " if i in inside else c for i, c in enumerate(text))
    want = set()
    for kind, a, b in spans:
        for m in personal._TERM.finditer(hidden):
            if m.start() >= a - 30 and m.end() <= b + 30:
                want.add((m[0].lower(), personal.entity(text, (kind, a, b))))
    assert personal.contexts(text, spans, 30) == want


def test_rare_entities_reveal_their_terms(spark):
    names = {k: [f"{c}{'o' * k}rvin" for c in "bdfghklm"] for k in (1, 2, 3)}
    rows, far = [], " ".join(["filler"] * 60)
    for k, of_k in names.items():
        for name in of_k:
            rows += [f"the man {name.title()} wrote from {name[:3]}.{k}@mail.example.org {far if i else 'here'} to {name}" for i in range(k)]
    rows += ["the man wrote from here to filler"] * 200
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")

    def marked(rules):
        found = {r.doc_id: r.terms for r in personal.personal_spans(docs, rules).collect()}
        assert not any(found[i] for i, t in enumerate(rows) if "@" not in t)
        return {rows[i][s.start : s.end].lower() for i, spans in found.items() for s in spans}

    assert marked(personal.Rules()) == {n for of_k in names.values() for n in of_k}
    assert marked(personal.Rules(support=2)) == {*names[2], *names[3]}
    assert marked(personal.Rules(support=4)) == set()


def test_words_inside_entities_are_not_counted(spark):
    # "quillon" stands in many addresses, but outside of them only beside one entity.
    rows = [(i, "Quillon wrote to desk@mail.example.org") for i in range(3)] + [(10 + i, f"to quillon@host{i}.example.org") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.term for s in r.terms] for r in personal.personal_spans(docs).collect()}
    assert all("quillon" in found[i] for i in range(3)) and not any("quillon" in found[10 + i] for i in range(50))


def test_many_entities_in_one_text(spark):
    text = " ".join(f"name{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]} a{i}@mail.example.org" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, "nothing here")] + [(i, "common words") for i in range(3, 60)], "doc_id long, text string")
    found = {r.doc_id: len(r.terms) for r in personal.personal_spans(docs).collect()}
    assert found[1] == 3000 and sum(found.values()) == 3000


def test_filter_holds_its_values(spark):
    terms = spark.range(20_000).selectExpr("concat('t', id) AS term")
    passes = personal._Passes(personal.term_filter(terms))
    assert all(passes[f"t{i}"] for i in range(20_000))
    assert sum(passes[f"u{i}"] for i in range(20_000)) < 3_000
