"""Near-duplicate join against brute force."""

import random

import numpy as np
import pytest
from test_repeats import morse

from palisade.llm.components import components
from palisade.llm.jaccard import LEVELS, labels, matched_depth, near_duplicates, one_of_each, shingles, shortened, target_depth

LAST = 1 << 64


def shingle_set(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["é", "日本"]
    out = []
    for i in range(40):
        base = rng.choices(vocab, k=rng.choice([3, 4, 5, 6, 30, 200]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((len(out) * 2, " ".join(w)))
    base = rng.choices(vocab, k=150)
    for i in range(90):  # a large group of near copies, all different
        w = list(base)
        w[rng.randrange(150)] = f"e{i}"
        out.append((10_000 + i, " ".join(w)))
    out += [(20_000 + i, out[0][1]) for i in range(30)]
    x, y = morse(2048)
    out += [(30_000, " ".join([x] * 5)), (30_001, " ".join([y] * 5)), (30_002, f"{x} {y} {x} {y} {x} u v w"), (30_003, f"{y} {x} {y} {x} {y} u v w")]
    out += [(1, None), (3, ""), (5, " "), (None, out[1][1]), (out[2]), (out[2][0], "a b c d e f g"), (7, "A b"), (9, "A  b"), ((1 << 63) - 1, "one of a kind"), ((1 << 63) - 1, None)]
    rng.shuffle(out)
    return out


def brute(rows):
    n, sets = len(rows), [shingle_set(t) for _, t in rows]
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(n):
            if link[i][j]:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        r = find(i)
        d = LAST if rows[i][0] is None else rows[i][0]
        least[r] = min(least.get(r, LAST), d)
    return sorted((LAST if rows[i][0] is None else rows[i][0], least[find(i)], sum(link[i]), len(sets[i])) for i in range(n)), len({find(i) for i in range(n)})


@pytest.mark.parametrize("block", [512, 16])
def test_against_brute_force(spark, block):
    rows = corpus(4)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, doc int, class int").repartition(4)
    fix = lambda x: LAST if x is None else x
    want, groups = brute(rows)
    got = sorted((fix(r.doc_id), fix(r.class_id), r.n_links, r.n_shingles) for r in near_duplicates(docs, block=block).collect())
    assert got == want
    if block == 512:
        kept = one_of_each(docs)
        assert kept.columns == docs.columns
        assert kept.count() == groups


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == one_of_each(docs).count() == 0


def test_depth():
    assert matched_depth(0.8) == 5
    assert 1 - (1 - 0.8**5) ** 32 > 0.99999
    for n in range(1, 60):  # the least similarity that a set of n can have with another one
        every = [i / (n + m - i) for m in range(1, 2 * n + 2) for i in range(min(n, m) + 1) if 5 * i >= 4 * (n + m - i) and not i == m == n]
        assert target_depth(n) == (matched_depth(min(every)) if every else LEVELS + 1)
    assert [target_depth(n) for n in (1, 3, 4, 7, 2000)] == [9, 9, 5, 7, 5]


def test_shortening():
    """Prefixes are shortened only where a class still looks for partners."""
    word = lambda *x: int.from_bytes(bytes(x), "big")
    a, b = word(1, 2, 3, 4, 5, 6, 7, 8), word(1, 2, 3, 4, 5, 6, 7, 9)
    c, d = word(1, 2, 3, 4, 5, 9, 9, 9), word(1, 2, 3, 4, 9, 9, 9, 9)
    label, cls = np.array([a, a, b, c, d], np.uint64), np.array([50, 10, 20, 30, 40])
    met = lambda until: sorted(map(tuple, shortened(np.zeros(5, np.int64), label, cls, np.array(until))[0].tolist()))
    assert met([8] * 5) == [(50, 10)]
    assert met([7] * 5) == [(20, 10), (50, 10)]
    assert met([5] * 5) == [(20, 10), (30, 10), (50, 10)]
    assert met([8, 8, 7, 8, 8]) == [(20, 10), (50, 10)]  # one that looks on meets those that don't
    assert met([8, 8, 8, 8, 4]) == [(20, 10), (30, 10), (40, 10), (50, 10)]
    assert met([9] * 5) == []
    assert shortened(np.arange(5), label, cls, np.full(5, 5))[0].tolist() == []
    # the same candidates whether tries are built at once or in parts
    rng = np.random.default_rng(2)
    label, cls, tree = rng.integers(0, 3, (400, 8)).astype(np.uint8).view(">u8")[:, 0].astype(np.uint64), rng.permutation(400), rng.integers(0, 2, 400)
    until = rng.integers(3, 9, 400)

    def groups(pairs):
        root = list(range(400))
        find = lambda x: x if root[x] == x else find(root[x])
        for x, y in pairs:
            root[max(find(x), find(y))] = min(find(x), find(y))
        return [find(i) for i in range(400)]

    whole = shortened(tree, label, cls, until)[0].tolist()
    brute_ = [(cls[i], cls[j]) for i in range(400) for j in range(i) if tree[i] == tree[j] and any(label[i] >> np.uint64(8 * (8 - k)) == label[j] >> np.uint64(8 * (8 - k)) for k in range(min(until[i], until[j]), 9))]
    assert groups(whole) == groups(brute_)


def test_recall():
    """Pairs at the threshold meet at the depth that they look to."""
    rng = random.Random(9)
    missed = total = 0
    for _ in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        other = base[:94] + [f"v{rng.randrange(10**6)}" for _ in range(10)]
        a, b = shingles(" ".join(base).encode()), shingles(" ".join(other).encode())
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert similarity >= 0.8
        depth = target_depth(len(a))
        x, y = labels(a), labels(b)
        shift = np.uint64(8 * (LEVELS - depth))
        missed += not (x >> shift == y >> shift).any()
        total += 1
    assert missed == 0 and total == 300


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))
