"""Substring and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from palisade.llm.substrings import deduped_documents, substring_dedup
from palisade.llm.suffixes import deduped_texts, interleave, intervals, suffix_array, suffix_dedup, transform

ID = {None: 1 << 63}


def name(d, t):
    return hashlib.sha256(f"{'null' if d is None else d}:{t or ''}".encode()).digest()[:16]


def brute(rows, window, units):
    """Mask of removed units by row; rows of one id are ordered by a hash of their text."""
    order = sorted(set(rows), key=lambda r: (ID.get(r[0], r[0]), name(*r)))
    seen, gone = {}, {}
    for place, (d, t) in enumerate(order):
        u = units(t)
        mask = [False] * len(u)
        for i in range(len(u) - window + 1):
            key = tuple(u[i : i + window])
            if seen.setdefault(key, (place, i)) != (place, i):
                mask[i : i + window] = [True] * window
        gone[d, t] = mask
    return gone


def words(t):
    return (t or "").encode().split()


def octets(t):
    return list((t or "").encode())


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "and", "x" * 9, "naïve", "ß", "a", "日本", "to"] + [f"w{i}" for i in range(300)]
    make = lambda k: rng.choices(vocab, k=k)
    shared = [make(45) for _ in range(6)]
    out = []
    for i in range(n):
        t = make(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(20)
            t[rng.randrange(len(t) + 1) : 0] = p[a : a + rng.randrange(15, 45)]
        out.append((i * 3, rng.choice([" ", "\n", "  "]).join(t)))
    base = " ".join(make(200))
    out += [(1000 + i, base) for i in range(40)]
    for i in range(60):  # near copies
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((2000 + i, " ".join(w)))
    out += [(4000 + i, " ".join(make(k) * 9)) for i, k in enumerate((1, 2, 3, 5, 7, 11, 19, 20, 21, 40))] + [(4100 + i, "abc é"[:k] * 60) for i, k in enumerate((1, 2, 3, 5))]
    out += [((1 << 63) - 1, base), (None, " ".join(make(60))), (None, "x " + base), (None, base + " y")]
    out += [(5000, "und " * 300), (5001, "und " * 90 + "x"), (5002, "ab" * 400), (6000, None), (6001, ""), (6002, " "), (None, base), (None, None), (1000, base), (3, "other " + base), (7000, " ".join(make(3000)) + base)]
    rng.shuffle(out)
    return out


def want_words(rows):
    gone = brute(rows, 20, words)
    return sorted((ID.get(d, d), len(m := gone[d, t]), sum(m), hashlib.sha256(b" ".join(w for w, g in zip(words(t), m, strict=True) if not g)).hexdigest()) for d, t in rows)


def want_bytes(rows):
    gone = brute(rows, 100, octets)
    out = []
    for d, t in rows:
        m = gone[d, t]
        out.append((ID.get(d, d), len(m), sum(m), sum(g and not h for g, h in zip(m, [False, *m], strict=False)), hashlib.sha256(bytes(b for b, g in zip(octets(t), m, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    hot = {"hot_here": 2, "hot": 3} if hot else {}
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, doc string, start int").repartition(5)
    got = sorted((ID.get(r.doc_id, r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs, **hot).collect())
    assert got == want_words(rows)
    got = sorted((ID.get(r.doc_id, r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, **hot).collect())
    assert got == want_bytes(rows)


def test_documents(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, doc string, cut int")
    cut = deduped_texts(docs)
    assert cut.columns == docs.columns
    gone = brute(rows, 100, octets)
    want = sorted((ID.get(d, d), t is None, bytes(b for b, g in zip(octets(t), gone[d, t], strict=True) if not g).decode("utf-8", "ignore")) for d, t in rows)
    assert sorted((ID.get(r.doc_id, r.doc_id), r.text is None, r.text or "") for r in cut.collect()) == want
    cut = deduped_documents(docs)
    assert cut.columns == docs.columns
    gone = brute(rows, 20, words)
    left = lambda d, t: " ".join(w.decode() for w, g in zip(words(t), gone[d, t], strict=True) if not g) if any(gone[d, t]) else t or ""
    assert sorted((ID.get(r.doc_id, r.doc_id), r.text is None, r.text or "") for r in cut.collect()) == sorted((ID.get(d, d), t is None, left(d, t)) for d, t in rows)


def test_nulls_and_rows_of_one_id(spark):
    """Many texts without an id, and with one id: none loses what only another one repeats."""
    rng = random.Random(5)
    make = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    a = make(60)
    rows = [(1, " ".join(a.split()[:30])), (None, a)] + [(None, make(60)) for _ in range(3000)] + [(7, make(40)) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((ID.get(r.doc_id, r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()) == want_words(rows)
    assert sorted((ID.get(r.doc_id, r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()) == want_bytes(rows)


def morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_sums(spark):
    """A word over two letters whose rolling hash equals that of its complement, whatever the multiplier."""
    x, y = morse(2048)
    rest = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*rest[:15], x, *rest[15:]])), (2, " ".join([*rest[:15], y, *rest[15:]])), (3, " ".join([*rest[:15], x, *rest[15:]])), (4, x), (5, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()) == want_words(rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()) == want_bytes(rows)


@pytest.mark.parametrize("letters", [b"ab", b"a", bytes(range(256)), b"\x00\xff"])
def test_suffix_array(letters):
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 17, 200):
        t = bytes(rng.choice(letters) for _ in range(n))
        order, rank = suffix_array(np.frombuffer(t, np.uint8), n + 1)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: t[i:])
        assert rank[order].tolist() == list(range(n + 1))


@pytest.mark.parametrize("width", [1, 2])
def test_interleave(width):
    """Merged transforms order strings as a plain sort of what they read backwards; common prefixes as by comparison."""
    rng = random.Random(7)
    for length in (2, 6, 12):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(30, 90))) for _ in range(4)] + [b"ab" * 20]
        made = [transform(np.frombuffer(t, np.uint8), 128, width) for t in texts]
        places = [np.arange(len(t) - length + 1) for t in texts]
        strings = [t[i : i + length] for t, p in zip(texts, places, strict=True) for i in p.tolist()]
        string, block, common = interleave(made, places, length, width)
        shared = lambda a, b: next((i for i in range(length) if a[i] != b[i]), length)
        want = [max(shared(s, t) // width * width for j, t in enumerate(strings) if j != i) for i, s in enumerate(strings)]
        assert common.tolist() == want
        # the interleave of the transforms: by context, then shard, then the shard's own order
        before = [(k, [t[:i][::-1] for i in p.tolist()]) for k, (t, p) in enumerate(zip(texts, places, strict=True))]
        rank = [(k, b) for k, bs in before for b in bs]
        twice = [i for i, s in enumerate(strings) if strings.count(s) > 1]
        assert string.tolist() == sorted(twice, key=lambda i: (strings[i][::-1], rank[i]))
        assert [strings[i] for i in string.tolist()] == [strings[string[np.flatnonzero(block == b)[0]]] for b in block.tolist()]


def test_intervals_over_shards():
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcdef") for _ in range(130))
    contents = [passage[i : i + 110] for i in range(0, 20, 3)] + [bytes(rng.choice(b"abcdef") for _ in range(100 + rng.randrange(40))) for _ in range(30)]
    counts = np.array([len(c) - 99 for c in contents])
    docs, starts = np.arange(len(contents))[::-1].copy(), np.arange(len(contents)) * 7
    places = sorted((d, s + j, c[j : j + 100], i, j) for i, (c, d, s) in enumerate(zip(contents, docs.tolist(), starts.tolist(), strict=True)) for j in range(len(c) - 99))
    first, want = {}, []
    for d, s, w, i, j in places:
        if first.setdefault(w, (d, s)) != (d, s):
            want.append((i, j))
    for shard in (200, 1000, 60_000):
        row, offset, size = intervals(contents, docs, starts, counts, shard=shard)
        assert sorted(zip(row.tolist(), offset.tolist(), strict=True)) == sorted(want) and set(size.tolist()) == {100}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(docs).count() == suffix_dedup(docs).count() == deduped_texts(docs).count() == 0
