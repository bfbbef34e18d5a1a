"""Repeated windows across documents: the distributed frame of the substring and the suffix-array dedup.

A window is a fixed number of units (bytes or words) of one document. The least hash of the short grams inside a window
is its anchor, a function of the window's content alone; consecutive windows with their first least gram at one place
make a fragment. Equal windows at two places so have one anchor in two fragments, even within one text. Hashes only
propose: wherever windows are taken for equal, their contents were compared.

1. `numbered`: a row is named by its doc_id and 128 bits of its text's hash; names are range-sorted by id (null last),
   then hash, and numbered in that order. Texts aren't part of that sort. Rows of one name are one document, and all
   get the same result.
2. `_anchors`, over every whole text: a row (anchor, name, position) for each fragment. Each task first drops fragments
   whose content it has seen at an earlier position (their windows are removed at once), so copies meet in the shuffle
   only once a task.
3. `_recurring`, by anchor: anchors that occur once anywhere can't hold a repeated window and go; the rest name the
   fragments that are needed.
4. `_contents` joins these to their texts, `resolve` receives them by anchor and finds each repeated window by the
   operator's own method.
5. The removed spans are gathered by document and joined to the text once more (the same exchange is read again).

Joins go by 64 bits of the name. Two names may share these: a request then reaches both texts and fetches a window too
many, which is compared like any other; what removes is checked against the whole name or the number.

Hot anchors: an anchor with many different fragments in one task is marked hot and only the mark goes through step 3;
fragments of a hot anchor are cut into windows and dealt by window content, so no task gets all of them. Steps 3 and 4
read rows sorted by key and hold a few groups at a time, whatever the size of their partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import materialize, text_name
from palisade.llm.hashing import VALUES, grams, mix, prefix, sliding_min, stretches, word_bounds

#: Fragments that a task holds at once, and contents it remembers; different fragments of one anchor in these that make
#: it hot; and the same over all.
CHUNK, REMEMBERED, HOT_HERE, HOT = 1_000_000, 150_000, 64, 4096
LONE, HOT_MARK, NEEDED_HOT, REMOVE, NEEDED = range(5)

#: resolve(contents, docs, starts, counts) -> (row, offset, size) of what to remove, by numbers of the given fragments.
Resolve = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Units:
    """How a text is cut into units, and how long windows and grams are."""

    def __init__(self, words: bool, window: int, gram: int, hot_here: int = HOT_HERE, hot: int = HOT):
        self.words, self.window, self.gram, self.hot_here, self.hot = words, window, gram, hot_here, hot

    def plain(self, raw: bytes) -> bytes:
        """The text as its units alone: words are joined by one space."""
        return b" ".join(raw.split()) if self.words else raw

    def fragments(self, plain: bytes) -> tuple[np.ndarray, ...]:
        """anchor, content hash, first window, count of windows, and each fragment's bounds in bytes."""
        raw = np.frombuffer(plain, np.uint8)
        values, start, end = VALUES[raw], None, None
        if self.words:
            start, end = word_bounds(raw)
            values = stretches(prefix(values), start, end)
        p = prefix(values)
        every = grams(p, self.gram)
        least = sliding_min(every, self.window - self.gram + 1)
        n = len(least)
        if not n:
            return (least, least, *[np.zeros(0, np.int64)] * 4)
        # a fragment ends where another gram is the least, or where the window leaves this one behind
        first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (every[: n - 1] == least[:-1]))))
        count = np.diff(np.append(first, n))
        last = first + count + self.window - 1
        content = stretches(p, first, last) + count.astype(np.uint64)
        return (least[first], content, first, count, first, last) if start is None else (least[first], content, first, count, start[first], end[last - 1])


def _route(name: Column) -> Column:
    return F.xxhash64(name)


def numbered(slim: DataFrame, parts: int) -> DataFrame:
    """route, names: a list of (name, doc), mostly of one; doc numbers names in order of id, null last, then hash."""
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("name")]
    names = slim.select("doc_id", "name").distinct().repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = materialize(names.select("name", F.monotonically_increasing_id().alias("doc")))
    return table.groupBy(_route(F.col("name")).alias("route")).agg(F.collect_list(F.struct("name", "doc")).alias("names"))


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a new group begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _sizes(new: np.ndarray) -> np.ndarray:
    """Size of the group of each element."""
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    return np.repeat(size, size)


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) ^ mix(at.view(np.uint64))).view(np.int64)


def _split(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, pa.Table]:
    """Of rows sorted by key those of whole groups, and those of the last one, which may go on."""
    t = pa.Table.from_batches(held)
    k = t.column(key).to_numpy()
    edge = int(np.searchsorted(k, k[-1]))
    return t.slice(0, edge), t.slice(edge)


FOUND = "kind byte, route long, row long, at long, size int"


def _anchors(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of FOUND. route: the anchor of LONE and HOT_MARK ones, half the name of what to REMOVE, any of the rest;
    row: the route of the text; at: first window << 8 | count of windows; size: units to remove."""

    def rows(kind: int | np.ndarray, route: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray | None = None) -> pa.RecordBatch:
        return _batch(kind=np.broadcast_to(np.int8(kind), len(route)) if np.isscalar(kind) else kind.astype(np.int8), route=route, row=row, at=at, size=np.zeros(len(route), np.int32) if size is None else size.astype(np.int32))

    def flush(texts: list[tuple], held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        # texts in order of id (null last), then name; equal rows share a number
        ids = sorted({t[0] for t in texts})
        number = {x: i for i, x in enumerate(ids)}
        plain: list[bytes] = [b""] * len(ids)
        route, second = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        of = np.zeros(len(texts), np.int64)
        for i, (x, r, text) in enumerate(texts):
            of[i] = k = number[x]
            plain[k], route[k], second[k] = text, r, int.from_bytes(x[2][8:], "little", signed=True)
        doc = np.repeat(of, [len(h[0]) for h in held])
        anchor, content, at, left, right = (np.concatenate([h[k] for h in held]) for k in range(5))
        held.clear()
        texts.clear()
        order = np.lexsort((at, doc, content, anchor))
        order = order[_groups(anchor[order], content[order], doc[order], at[order])]
        anchor, content, doc, at, left, right = (x[order] for x in (anchor, content, doc, at, left, right))
        new = _groups(anchor, content)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        copy = ~new
        for i in np.flatnonzero(copy).tolist():
            h = head[i]
            if plain[doc[i]][left[i] : right[i]] != plain[doc[h]][left[h] : right[h]]:
                copy[i] = False  # equal hashes of unequal contents: both stay
        gone, start, end = merged(doc[copy], at[copy] >> 8, (at[copy] >> 8) + (at[copy] & 0xFF) + units.window - 1)
        plain.clear()
        del order, content, left, right, head, new
        yield rows(REMOVE, second[gone], route[gone], start << 8, end - start)
        anchor, doc, at = anchor[~copy], doc[~copy], at[~copy]
        new = _groups(anchor)
        hot = _sizes(new) > units.hot_here
        marks = hot & new
        o = np.lexsort((at, doc))  # in order of documents rows compress better
        yield rows(np.where(hot, NEEDED_HOT, LONE)[o], np.where(hot, _spread(route[doc], at), anchor)[o], route[doc][o], at[o])
        yield rows(HOT_MARK, anchor[marks], route[doc[marks]], at[marks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple] = []
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for b in batches:
            for doc, name, route, text in zip(b.column("doc_id").to_pylist(), b.column("name").to_pylist(), b.column("route").to_pylist(), b.column("text"), strict=True):
                raw = text.as_buffer()
                if raw is None or len(raw) < units.window:
                    continue
                plain = units.plain(raw.to_pybytes())
                anchor, content, first, n, left, right = units.fragments(plain)
                if len(anchor):
                    texts.append(((doc is None, doc or 0, name), route, plain))
                    held.append((anchor.view(np.int64), content.view(np.int64), first << 8 | n, left, right))
                    count += len(n)
                if count >= CHUNK:
                    yield from flush(texts, held)
                    texts, held, count = [], [], 0
        yield from flush(texts, held)

    return run


def _recurring(units: Units, rows: int = 50_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of FOUND sorted by route in; those of the fragments that are needed, and of those removed already, out."""

    def settled(t: pa.Table, all_hot: bool = False) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        kind, route = t.column("kind").to_numpy(), t.column("route").to_numpy()
        asks = (kind == LONE) | (kind == HOT_MARK)
        group = np.cumsum(_groups(route)) - 1
        size = np.bincount(group, weights=kind == LONE)
        hot = (np.bincount(group, weights=kind == HOT_MARK) > 0) | (size > units.hot) | all_hot
        keep = ~asks | ((kind == LONE) & ((size > 1) | hot)[group])
        out = np.where(asks, np.where(hot[group], NEEDED_HOT, NEEDED), kind).astype(np.int8)
        yield from t.set_column(t.column_names.index("kind"), "kind", pa.array(out)).filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        long: int | None = None  # the route of a group whose head was let go as hot
        for b in batches:
            if long is not None:
                n = int(np.searchsorted(b.column("route").to_numpy(), long, "right"))
                yield from settled(pa.Table.from_batches([b.slice(0, n)]), True)
                b = b.slice(n)
            if not b.num_rows:
                continue
            long = None
            held.append(b)
            if sum(x.num_rows for x in held) < rows:
                continue
            whole, rest = _split(held, "route")
            yield from settled(whole)
            held = rest.to_batches()
            if rest.num_rows > max(units.hot, rows):
                long, held = rest.column("route")[0].as_py(), []
                yield from settled(rest, True)
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


CUT = "key long, route long, doc long, at long, size int, content binary"


def _number(names: pa.Scalar, name: bytes) -> int:
    return next(x["doc"] for x in names.as_py() if x["name"] == name)


def _contents(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of CUT: the needed fragments of each text with their contents. at: start << 8 | count of windows. A content
    that the task has seen at an earlier position isn't sent again: it is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            keys, docs, ats, sizes, contents, routes = [], [], [], [], [], []
            for name, route, names, text, found in zip(b.column("name").to_pylist(), b.column("route").to_pylist(), b.column("names"), b.column("text"), b.column("found"), strict=True):
                raw = text.as_buffer()
                plain = units.plain(b"" if raw is None else raw.to_pybytes())
                doc, second = _number(names, name), int.from_bytes(name[8:], "little", signed=True)
                left, right = None, None
                if units.words:
                    start, end = word_bounds(np.frombuffer(plain, np.uint8))
                    left, right = start.tolist(), end.tolist()
                n_units = len(plain) if left is None else len(left)
                found = found.values
                for kind, r, at, size in zip(*(found.field(c).to_numpy().tolist() for c in ("kind", "route", "at", "size")), strict=True):
                    first, n = at >> 8, at & 0xFF
                    if kind == REMOVE:
                        if r == second and first + size <= n_units:
                            keys.append(r ^ at)
                            ats.append(at)
                            sizes.append(size)
                            contents.append(None)
                        continue
                    if first + n + units.window - 1 > n_units:
                        continue  # asked of another text with this route
                    for f, m in [(first, n)] if kind == NEEDED else [(first + j, 1) for j in range(n)]:
                        last = f + m + units.window - 1
                        cut = plain[f:last] if left is None else plain[left[f] : right[last - 1]]
                        here = (doc, f << 8 | m)
                        seen = places.get(cut, here)
                        if seen >= here:
                            if len(places) >= REMEMBERED:
                                places.clear()
                            places[cut] = here
                        keys.append(r if kind == NEEDED else int.from_bytes(hashlib.blake2b(cut, digest_size=8).digest(), "little", signed=True))
                        ats.append(here[1])
                        sizes.append(last - f)
                        contents.append(cut if seen >= here else None)
                new = len(ats) - len(docs)
                docs += [doc] * new
                routes += [route] * new
            if docs:
                arrays = [pa.array(keys, pa.int64()), pa.array(routes, pa.int64()), pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int32()), pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in CUT.split(", ")])

    return run


SPAN = "route long, doc long, start long, size int"


def _resolved(resolve: Resolve, block: int, bytes_: int = 8 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of CUT sorted by key in, rows of SPAN out. Of equal contents the earliest stands for all, the others are
    removed; what is left goes to resolve, about `block` fragments or so many bytes of whole keys at a time."""

    def spans(route: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(doc):
            _, one = np.unique(doc, return_index=True)
            of = dict(zip(doc[one].tolist(), route[one].tolist(), strict=True))
            doc, start, end = merged(doc, start, start + size)
            yield _batch(route=np.array([of[d] for d in doc.tolist()], np.int64), doc=doc, start=start, size=(end - start).astype(np.int32))

    def distinct(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The earliest row of each content, and the numbers of the rows that are removed whole."""
        doc, at = t.column("doc").to_numpy(), t.column("at").to_numpy()
        contents = t.column("content").to_pylist()
        first: dict[bytes, int] = {}
        gone = []
        for i in np.lexsort((at, doc)).tolist():
            c = contents[i]
            k = first.setdefault(c, i) if c is not None else None
            if k is None or (k != i and (doc[k], at[k]) != (doc[i], at[i])):
                gone.append(i)
        return t.take(pa.array(sorted(first.values()), pa.int64())), np.array(gone, np.int64)

    def columns(t: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        return t.column("route").to_numpy()[rows], t.column("doc").to_numpy()[rows], t.column("at").to_numpy()[rows] >> 8, t.column("size").to_numpy()[rows]

    def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kept, gone = distinct(t)
        out = columns(t, gone)
        if kept.num_rows:
            route, doc, at = (kept.column(c).to_numpy() for c in ("route", "doc", "at"))
            row, offset, size = resolve(kept.column("content").to_pylist(), doc, at >> 8, at & 0xFF)
            out = tuple(np.concatenate(x) for x in zip(out, (route[row], doc[row], (at >> 8)[row] + offset, size), strict=True))
        yield from spans(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) < block and sum(x.nbytes for x in held) < bytes_:
                continue
            whole, rest = _split(held, "key")
            if whole.num_rows:
                yield from settled(whole)
            if rest.num_rows >= block or rest.nbytes >= bytes_:
                kept, gone = distinct(rest)
                yield from spans(*columns(rest, gone))
                rest = kept
            held = rest.to_batches()
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans that touch or overlap, by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    own = (np.cumsum(_groups(doc)) - 1) << 32
    reach = np.maximum.accumulate(end + own)  # the furthest end so far, inside each text
    new = _groups(doc)
    new[1:] |= start[1:] + own[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach - own)[last]


def with_removed(docs: DataFrame, units: Units, resolve: Resolve, finish: Callable[[pa.RecordBatch, Iterator[tuple[bytes, np.ndarray]]], pa.RecordBatch], schema: str | T.StructType, block: int, carry: bool = False) -> DataFrame:
    """finish(rows, texts) over every row of docs: a batch with doc_id and, with carry, the other columns as the struct
    `row`; of each text the bytes and a mask of the removed units, one at a time."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if carry else []
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_name(F.col("doc_id").cast("long"), F.col("text")).alias("name"), *others).withColumn("route", _route(F.col("name")))
    # both joins below read the same columns of it, hence the same exchange
    dealt = slim.repartition(parts, "route").join(numbered(slim.select("doc_id", "name"), parts).hint("shuffle_hash"), "route")
    columns = ["route", "doc_id", "name", "names", "text", *(["row"] if carry else [])]
    found = (
        slim.select("doc_id", "name", "route", "text")
        .mapInArrow(_anchors(units), FOUND)
        .repartition(parts, "route")
        .sortWithinPartitions("route")
        .mapInArrow(_recurring(units), FOUND)
        .groupBy(F.col("row").alias("route_"))
        .agg(F.collect_list(F.struct("kind", "route", "at", "size")).alias("found"))
        .withColumnRenamed("route_", "route")
    )
    spans = (
        dealt.join(found.hint("shuffle_hash"), "route")
        .select(*columns, "found")
        .mapInArrow(_contents(units), CUT)
        .repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_resolved(resolve, block), SPAN)
        .groupBy("route")
        .agg(F.collect_list(F.struct("doc", "start", "size")).alias("spans"))
    )

    def masked(b: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
        for name, names, text, spans in zip(b.column("name"), b.column("names"), b.column("text"), b.column("spans"), strict=True):
            raw = text.as_buffer()
            raw = b"" if raw is None else raw.to_pybytes()
            yield raw, removed_units(len(raw.split()) if units.words else len(raw), spans, _number(names, name.as_py()) if spans.is_valid else -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield finish(b, masked(b))

    return dealt.join(spans.hint("shuffle_hash"), "route", "left").select(*columns, "spans").mapInArrow(run, schema)


def removed_units(n: int, spans: pa.Scalar, doc: int) -> np.ndarray:
    """Mask of the removed ones of a text's n units."""
    gone = np.zeros(n + 1, np.int32)
    if spans.is_valid and n:
        of, start, size = (spans.values.field(c).to_numpy() for c in ("doc", "start", "size"))
        own = of == doc
        np.add.at(gone, start[own], 1)
        np.add.at(gone, np.minimum(start[own] + size[own], n), -1)
    return np.cumsum(gone[:-1]) > 0
