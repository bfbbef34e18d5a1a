"""Suffix-array dedup: repeated byte strings from merged Burrows-Wheeler transforms.

Fragments that may hold a repeated string are dealt by anchor (see repeats.py). What meets is cut into shards of bounded
size. Each shard's text is suffix-sorted on its own, read backwards, which gives its transform: the symbol that follows
each place, in order of what precedes it, and the step from a place to the next one's rank. The transforms of all shards
are then merged by refining one interleave, which reads these transforms only: it starts with the ranks of all windows'
first places, shard by shard and with no context; each round reads the symbols there, distributes the interleave by
them, stably, and steps on, so that it is right for contexts longer by a symbol. No suffixes are sorted or compared
again. A block of the interleave has one context; where a boundary first parts two neighbours is their common prefix,
and blocks that stay together for the whole length are the repeated intervals. Windows alone in their block are done.

Defined cases: null, empty and short texts lose nothing; repeated rows are one document and lose alike; different texts
of one id, or of no id, are documents of their own, ordered by a hash of 128 bits; texts of any length are read whole;
ties don't occur, as names differ; an empty table gives an empty result; other columns are ignored by `suffix_dedup` and
kept by `deduped_texts`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.repeats import Units, with_removed

WINDOW, GRAM = 100, 32
#: Fragments merged at once, and bytes of a shard, whose ranks fit in 16 bits.
BLOCK, SHARD = 40_000, 60_000


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the text (the empty one included) in order of their first `depth` symbols at least, and the rank of
    each, by doubling; ties in order of place. Fewer than 2**16 suffixes."""
    n = len(text) + 1
    rank = np.zeros(n, np.uint16)
    rank[:-1] = text
    rank[:-1] += 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        key = rank[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        if k > 1:  # the first round sorts by one symbol
            half = np.zeros(n, np.uint16)
            half[: n - k // 2] = rank[k // 2 :]
            half = half[order]
            new[1:] |= half[1:] != half[:-1]
        number = np.cumsum(new) - 1
        rank = np.empty(n, np.uint16)
        rank[order] = number
        if number[-1] == n - 1 or k >= depth:
            break
        # by the second half: those without one first, then the others as they are sorted already
        by_half = np.concatenate((np.arange(n - k, n), order[order >= k] - k)) if k < n else order
        order = by_half[np.argsort(rank[by_half], kind="stable")]
        k *= 2
    final = np.empty(n, np.int64)
    final[order] = np.arange(n)
    return order, final


@dataclass
class Transform:
    """Of a text read backwards: for each place, in order of what precedes it, the `width` symbols that follow, and the
    rank of the place behind these. rank: of each place."""

    symbols: np.ndarray
    step: np.ndarray
    rank: np.ndarray


def transform(text: np.ndarray, depth: int, width: int = 2) -> Transform:
    order, rank = suffix_array(text[::-1], depth)
    n = len(text)
    place = n - order  # the suffix at i of the reversed text is what precedes place n - i
    padded = np.concatenate((text, np.zeros(width, np.uint8)))
    symbols = padded[place].astype(np.uint16)
    if width == 2:  # the nearer symbol weighs less, so that it is the lesser of two steps
        symbols |= padded[place + 1].astype(np.uint16) << 8
    forward = rank[::-1]  # by place
    return Transform(symbols, forward[np.minimum(place + width, n)], forward)


def interleave(transforms: list[Transform], places: list[np.ndarray], length: int, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms for the strings of a length (a multiple of width) that start at these places of each.

    Returns the numbers of the strings (in the order given) that are equal to another one, as interleaved; the interval
    of each; and for every string its longest common prefix with any other, in whole steps of width.
    """
    base = np.cumsum([0, *[len(t.step) for t in transforms]])
    symbols = np.concatenate([t.symbols for t in transforms])
    step = np.concatenate([t.step + b for t, b in zip(transforms, base, strict=False)])
    at = np.concatenate([t.rank[p] + b for t, p, b in zip(transforms, places, base, strict=False)])
    common = np.zeros(len(at), np.int32)
    string = np.argsort(at, kind="stable")  # no context yet: shard by shard, in each one's order
    at = at[string]
    block = np.zeros(len(at), np.int64)
    for depth in range(width, length + 1, width):
        symbol = symbols[at]
        order = np.argsort(symbol, kind="stable")  # a radix distribution for 16 bits
        symbol, block, string = symbol[order], block[order], string[order]
        at = step[at[order]]
        apart = np.ones(len(order), bool)
        apart[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        alone = apart.copy()
        alone[:-1] &= apart[1:]
        block = np.cumsum(apart)
        together = ~alone
        string, at, block = string[together], at[together], block[together]
        common[string] = depth
        if not len(string):
            break
    return string, block, common


def intervals(contents: list[bytes], docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int = WINDOW, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, offset, size) of all strings of the window's length but each one's first."""
    sizes = np.array([len(c) for c in contents])
    text = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(contents)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (ends - sizes)[row] + offset
    made, placed, at = [], [], 0
    while at < len(contents):  # whole fragments, about a shard's bytes at a time
        begin = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + shard, "right")))
        a, b = np.searchsorted(row, (at, to))
        made.append(transform(text[begin : int(ends[to - 1])], window))
        placed.append(place[a:b] - begin)
        at = to
    string, block, _ = interleave(made, placed, window)
    if not len(string):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((starts[row[string]] + offset[string], docs[row[string]], block))
    string, block = string[order], block[order]
    later = np.zeros(len(string), bool)
    later[1:] = block[1:] == block[:-1]
    # one place may come in two fragments of one content only, and contents are distinct
    found = string[later]
    return row[found], offset[found], np.full(len(found), window)


def _resolve(window: int):
    def resolve(contents, docs, starts, counts):
        return intervals(contents, docs, starts, counts, window)

    return resolve


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **hot: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. The window's length is even."""

    def finish(b: pa.RecordBatch, texts: Iterator[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        n_bytes, removed, runs, kept = zip(*[(len(t), int(m.sum()), int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()), hashlib.sha256(_kept(t, m)).hexdigest()) for t, m in texts], strict=True)
        columns = [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_bytes, removed, runs)], pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_removed(docs, Units(False, window, gram, **hot), _resolve(window), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", BLOCK)


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text


def deduped_texts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, all columns and rows, with repeated bytes cut from their texts; bytes of characters cut in half go too."""

    def finish(b: pa.RecordBatch, texts: Iterator[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        there = b.column("text").is_valid().to_pylist()
        cut = [_kept(t, m).decode("utf-8", "ignore") if ok else None for (t, m), ok in zip(texts, there, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("row"), pa.array(cut, pa.string())], ["row", "cut"])

    row = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = T.StructType([T.StructField("row", row), T.StructField("cut", T.StringType())])
    cut = with_removed(docs, Units(False, window, gram), _resolve(window), finish, schema, BLOCK, carry=True)
    return cut.select(*[F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
