"""Plain versions of the operators' contracts, for small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order_key(doc_id):
    return (doc_id is None, -(doc_id or 0))


def edited(rows):
    """(doc_id, edited text) of rows with distinct ids, after descending doc_id."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: order_key(r[0]))
    out = {}
    for at, (i, t) in enumerate(rows):
        half = len(t) // 2
        out[i] = t[: len(t) - half] + rows[(at + 1) % len(rows)][1][:half]
    return out


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight; stop those above their limit; share what is left again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, done, left = set(names), {}, share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not above:
            return done | {s: level * weight[s] for s in open_}
        for s in above:
            done[s] = most * sizes[s]
            left -= done[s]
            open_.remove(s)
    return done


def simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Smallest id reachable over links of fingerprints, for (id, fingerprint) rows."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            parent[root(int(j) + i + 1)] = root(i)
    least = {}
    for i, (d, _) in enumerate(prints):
        ids = [x for x in (least.get(root(i)), d) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return [(d, p, least[root(i)]) for i, (d, p) in enumerate(prints)]


def base_spans(text):
    """The patterns as they are written, one regular expression each."""
    text = text or ""
    found = []
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for number, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), number, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def dedup_lines(rows):
    """{doc_id: (lines, dropped, kept text)} of rows with distinct ids."""
    strip = " \t\n\x0b\x0c\r"
    held = collections.defaultdict(set)
    cut = {i: (t or "").split("\n") for i, t in rows}

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))

    for i, lines in cut.items():
        for line in lines:
            if len(key(line)) >= 40 and i is not None:
                held[key(line)].add(i)
    out = {}
    for i, lines in cut.items():
        kept = [x for x in lines if len(held[key(x)]) < 5 or i == max(held[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def token_ids(texts, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [[*e.ids, 2] for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def best_fit_decreasing(lengths, room):
    """Number of bins, piece by piece."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, left in enumerate(bins) if left >= length]
        if fitting:
            bins[min(fitting, key=lambda i: bins[i])] -= length
        else:
            bins.append(room - length)
    return len(bins)


def inner_products(rows, queries, k):
    """(query_id, rank, vec_id, score) by comparing each query with every row."""
    out = []
    for query_id, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != query_id and len(v) == len(q))
        out += [(query_id, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return out
