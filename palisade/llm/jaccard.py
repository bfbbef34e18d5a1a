"""N-gram Jaccard join by a MinHash LSH forest.

Copies (equal shingle sets) count as one class throughout. Each class has a label in every tree: LEVELS minima of its
own hash functions, a byte of each, in order. Labels sorted by tree form the tree's prefix trie: classes with a common
prefix are neighbours. Every class looks for partners at the full depth first; then matched prefixes are shortened a
level at a time, but a class stops where its recall target is met: where the least similar partner that a set of its
size can have meets it in some tree with the target probability (`target_depth`; sets too small for any partner never
look). A prefix that a class still looks at links all classes below it, told as a star around the least, which alone
goes on to shorter prefixes. Tries are built in each task first, so a prefix that very many share leaves a task once.

Connected candidates make a container, and within each container the exact similarity of word shingles is computed, by
blocks of classes, for every pair.

Similarity is the Jaccard index of the sets of five-word shingles, links are pairs of 0.8 or more, and groups are the
connected components of links. A text of one to four words has all its words as its only shingle; a text without words
is in no link. Words are compared by 64 bits of a keyed hash, sets by 128.

Defined cases: a null text has no words; a null doc_id comes after all others; repeated rows are copies of each other;
rows that share a doc_id are documents of their own, ordered by a hash of 128 bits; texts of any length are read whole;
an empty table gives an empty result; other columns are ignored by `near_duplicates` and kept by `one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, rest_of_row, text_name
from palisade.llm.components import components
from palisade.llm.hashing import grams, mix, prefix, stretches

SHINGLE, TREES, LEVELS, RECALL = 5, 32, 8, 0.99999
THRESHOLD = (4, 5)
#: Members of a container compared at a time; columns of a block's matrix; classes whose tries a task builds at once.
BLOCK, COLUMNS, CHUNK = 256, 8192, 16_000
#: Words and sets that a task remembers.
WORDS, SETS = 100_000, 250_000


def matched_depth(similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of this similarity meets in one of the trees with the target probability."""
    depth = LEVELS
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


@cache
def target_depth(n: int, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The depth at which a set of n shingles has met each partner with the target probability; beyond LEVELS if there
    can be none. A partner's similarity is a fraction both / either with both <= n <= either."""
    a, b = threshold
    if n > 1000:
        return matched_depth(a / b, trees, recall)
    least = [both / either for either in range(n, n * b // a + 1) if (both := -(-a * either // b)) <= n and (both < n or either > n)]
    least += [n / (n + 1)] if n * b >= a * (n + 1) else []
    return matched_depth(min(least), trees, recall) if least else LEVELS + 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"palisade").digest(), "little")
        return h


def shingles(raw: bytes, size: int = SHINGLE, known: _Words | None = None) -> np.ndarray:
    """Sorted hashes of the set of word shingles. known: words that the task has hashed."""
    words = raw.split()
    w = np.fromiter(map((_Words() if known is None else known).__getitem__, words), np.uint64, len(words))
    p = prefix(w)
    if len(w) < size:
        return stretches(p, np.zeros(1, np.int64), np.array([len(w)])) if len(w) else w
    return np.unique(grams(p, size))


_multipliers = mix(np.arange(1, 4097, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_offsets = mix(np.arange(5000, 9096, dtype=np.uint64)).astype(np.uint32)


def labels(hashes: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The label of a set in each tree, as a number: its minima in order, a byte of each."""
    k = trees * LEVELS
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    minima = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 128):
        x = low[i : i + 128, None] * _multipliers[:k]
        x ^= high[i : i + 128, None]
        x += _offsets[:k]
        x *= np.uint32(0x9E3779B1)
        np.minimum(minima, x.min(0), out=minima)
    part = mix(minima.astype(np.uint64)) >> np.uint64(56)
    return part.astype(np.uint8).reshape(trees, LEVELS).view(">u8")[:, 0].astype(np.uint64)


def _sets(trees: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[bytes] = set()
        known = _Words()
        for b in batches:
            keys, n, signs = [], [], []
            for text in b.column("text"):
                raw = text.as_buffer()
                s = shingles(b"" if raw is None else raw.to_pybytes(), size, known)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                keys.append(key)
                n.append(len(s))
                if not len(s) or key in signed:  # once a task is enough
                    signs.append(None)
                else:
                    if len(signed) < SETS:
                        signed.add(key)
                    signs.append(labels(s, trees).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("name"), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(signs, pa.binary())], ["doc_id", "name", "key", "n_shingles", "labels"])

    return run


def shortened(tree: np.ndarray, label: np.ndarray, cls: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (class, least class) from entries of tries, and the numbers of the entries left: the least of each
    prefix that was linked. until: the depth that a class looks to; the least of a prefix looks as far as any below it."""
    order = np.lexsort((cls, label, tree))
    until = until.copy()
    out = [np.zeros((0, 2), np.int64)]
    for level in range(LEVELS, 0, -1):
        t, p = tree[order], label[order] >> np.uint64(8 * (LEVELS - level))
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        first = np.flatnonzero(new)
        if len(first) == len(order):
            continue
        run = np.cumsum(new) - 1
        looks = np.minimum.reduceat(until[order], first)
        by_class = np.lexsort((cls[order], run))  # the least class of a run comes first
        order, looked = order[by_class], looks[run] <= level
        head = order[first][run]
        linked = looked & ~new
        out.append(np.stack([cls[order[linked]], cls[head[linked]]], 1))
        until[order[first]] = looks
        order = order[~linked]  # in order of tree and prefix still; those below one prefix in order of class
        order = order[np.lexsort((label[order], tree[order]))]
    pairs = np.concatenate(out)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0), order


ENTRY = "node long, tree int, label long, until int, class long, other long"
_EDGE = -1


def _entry(node: np.ndarray, tree: np.ndarray, label: np.ndarray, until: np.ndarray, cls: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(tree.astype(np.int32)), pa.array(label.view(np.int64)), pa.array(until.astype(np.int32)), pa.array(cls), pa.array(other)], [c.split()[0] for c in ENTRY.split(", ")])


def _told(pairs: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(pairs), np.int64)
    return _entry(mix(pairs[:, 0].astype(np.uint64)), zero + _EDGE, zero, zero, pairs[:, 0], pairs[:, 1])


def _entries(trees: int, shortest: int, threshold: tuple[int, int], recall: float):
    """Rows of ENTRY: the candidates of each task's own tries, and the entries left. node deals entries by the shortest
    prefix."""

    def flush(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        label = np.concatenate([np.frombuffer(h[2], np.uint64) for h in held])
        tree = np.tile(np.arange(trees), len(held))
        cls = np.repeat(np.array([h[0] for h in held], np.int64), trees)
        until = np.repeat(np.array([target_depth(h[1], threshold, trees, recall) for h in held], np.int64), trees)
        pairs, left = shortened(tree, label, cls, until)
        yield _told(pairs)
        tree, label, cls, until = tree[left], label[left], cls[left], until[left]
        node = mix(label >> np.uint64(8 * (LEVELS - shortest)) ^ mix(tree.astype(np.uint64) + np.uint64(1)))
        yield _entry(node, tree, label, until, cls, np.zeros(len(cls), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        for b in batches:
            for c, n, s in zip(*(b.column(x).to_pylist() for x in ("class", "n_shingles", "labels")), strict=True):
                if target_depth(n, threshold, trees, recall) <= LEVELS:
                    held.append((c, n, s))
            if len(held) >= CHUNK:
                yield from flush(held)
                held = []
        yield from flush(held)

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates a, b from rows of ENTRY sorted by node. A node has a few entries of each task at most."""

    def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, cls, other = (t.column(c).to_numpy() for c in ("tree", "class", "other"))
        known = tree == _EDGE
        label, until = t.column("label").to_numpy().view(np.uint64), t.column("until").to_numpy().astype(np.int64)
        pairs, _ = shortened(tree[~known], label[~known], cls[~known], until[~known])
        pairs = np.concatenate([pairs, np.stack([cls[known], other[known]], 1)])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= 100_000:
            t = pa.Table.from_batches(held)
            node = t.column("node").to_numpy()
            edge = int(np.searchsorted(node, node[-1]))
            if edge:
                yield from settled(t.slice(0, edge))
                held = t.slice(edge).to_batches()
    if held:
        yield from settled(pa.Table.from_batches(held))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of columns; shingles of one set only are left out."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((n, n), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for base in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (base, base + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[a:b], column[a:b] - base] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def linked_pairs(sets: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Matrix of the pairs whose Jaccard index reaches the threshold."""
    inter = intersections(sets)
    size = np.array([len(s) for s in sets])
    union = size[:, None] + size[None, :] - inter
    return inter * threshold[1] >= union * threshold[0]


def _roots(linked: np.ndarray) -> np.ndarray:
    """Number of the first member of each member's component."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: tuple[int, int]):
    """class, links, root from rows sorted by box, i, j: a pair of blocks at a time."""

    def settled(key: tuple[int, int, int], rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[:2])
        block, cls, weight = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        linked = linked_pairs([np.frombuffer(r[3], np.uint64) for r in rows], threshold)
        np.fill_diagonal(linked, False)
        if key[1] != key[2]:
            first = block == key[1]
            linked &= first[:, None] != first[None, :]
        got = linked.any(1)
        if not got.any():
            return None
        root = cls[_roots(linked)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[got], linked[got] @ weight, root[got])], ["class", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for box, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("box", "i", "j", "block", "class", "size", "set")), strict=True):
                if (box, i, j) != now:
                    if rows and (out := settled(now, rows)) is not None:
                        yield out
                    now, rows = (box, i, j), []
                rows.append(tuple(row))
        if rows and (out := settled(now, rows)) is not None:
            yield out

    return run


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            sets = []
            for text in b.column("text"):
                raw = text.as_buffer()
                sets.append(shingles(b"" if raw is None else raw.to_pybytes(), size, known).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("box"), b.column("block"), b.column("blocks"), b.column("class"), b.column("size"), pa.array(sets, pa.binary())], ["box", "block", "blocks", "class", "size", "set"])

    return run


def grouped(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, name (see common.text_name), n_shingles, copies (rows of the class), n_links, and of the group the least
    document's `head`: struct unnamed (it has no id), doc_id, name."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shortest = matched_depth(threshold[0] / threshold[1], trees, recall)
    id_ = F.col("doc_id").cast("long")
    slim = docs.select(id_.alias("doc_id"), "text", text_name(id_, F.col("text")).alias("name"))
    found = materialize(slim.mapInArrow(_sets(trees, size), "doc_id long, name binary, key binary, n_shingles int, labels binary"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "name")
    sets = found.filter("n_shingles > 0").groupBy("key", "n_shingles").agg(F.count("*").alias("size"), F.min(first).alias("first"), F.max("labels").alias("labels"))
    classes = materialize(sets.withColumn("class", F.monotonically_increasing_id()))  # written, so numbers stay

    entries = classes.select("class", "n_shingles", "labels").mapInArrow(_entries(trees, shortest, threshold, recall), ENTRY)
    candidates = components(entries.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_matched, "a long, b long").distinct())
    boxes = materialize(candidates.unionByName(candidates.select(F.col("label").alias("node"), "label").distinct()).select(F.col("node").alias("class"), F.col("label").alias("box")).distinct())

    # blocks of each container; the pairs of blocks are compared on their own
    sizes = boxes.groupBy("box").agg(F.expr(f"cast(ceil(count(*) / {block}) as int)").alias("blocks"))
    placed = boxes.join(sizes, "box").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    firsts = placed.join(classes.select("class", "size", "first"), "class").select("box", "block", "blocks", "class", "size", F.col("first.name").alias("name"))
    texts = slim.join(firsts.hint("shuffle_hash"), "name").select("box", "block", "blocks", "class", "size", "text")
    shipped = texts.mapInArrow(_with_sets(size), "box long, block int, blocks int, class long, size long, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # rows of one id and text are one class's
    pairs = shipped.dropDuplicates(["class"]).select("*", other).select("box", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "size", "set")
    links = materialize(pairs.repartition(parts, "box", "i", "j").sortWithinPartitions("box", "i", "j").mapInArrow(_verify(threshold), "class long, links long, root long"))

    count = links.groupBy("class").agg(F.sum("links").alias("links"))
    label = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    named = classes.drop("labels").join(count, "class", "left").join(label.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    named = named.join(heads, "label").select("key", "size", F.coalesce("links", F.lit(0)).alias("links"), "head")
    return found.join(named, "key", "left").select(
        "doc_id", "name", "n_shingles", F.coalesce("size", F.lit(1)).alias("copies"), (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_links"), F.coalesce("head", first).alias("head")
    )


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group), n_links (documents linked to it, copies included),
    n_copies (documents with its shingle set, itself included), n_shingles."""
    return grouped(docs, **parameters).select("doc_id", F.col("head.doc_id").alias("class_id"), "n_links", F.col("copies").alias("n_copies"), "n_shingles")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, with one document of each group: the least. Of rows with one id and text the one
    stays whose other columns hash least."""
    winners = grouped(docs, **parameters).select(F.col("head.name").alias("won")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), text_name(F.col("doc_id").cast("long"), F.col("text")).alias("name"), rest_of_row(docs.columns, "doc_id", "text").alias("rest"))
    kept = rows.join(winners, F.col("name") == F.col("won"), "left_semi")
    return kept.groupBy("name").agg(F.min_by("row", "rest").alias("row")).select("row.*")
