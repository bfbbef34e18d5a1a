"""Substring dedup with repeated-phrase automata.

Passages that recur are confirmed by content within their shard (see repeats.py for how documents are dealt to shards),
each shard compiles its confirmed passages into an Aho-Corasick automaton over words, and every fragment of its
documents streams through it, which locates all occurrences. The occurrence that starts first stays, words of the others
go.

Defined cases: null, empty and short texts lose nothing; repeated rows are one document and lose alike; different texts
of one id, or of no id, are documents of their own, ordered by a hash of 128 bits; texts of any length are read whole;
ties don't occur, as names differ; an empty table gives an empty result; other columns are ignored by `substring_dedup`
and kept by `deduped_documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.repeats import Units, with_removed

WINDOW, GRAM = 20, 8
#: Fragments looked at together, and passages in one automaton.
SHARD, PASSAGES = 10_000, 20_000


def as_strings(contents: list[bytes]) -> list[str]:
    """One character a word, the same word the same character."""
    letters: dict[bytes, str] = {}
    out = []
    for c in contents:
        chars = []
        for w in c.split(b" "):
            ch = letters.get(w)
            if ch is None:
                k = len(letters) + 1
                ch = letters[w] = chr(k if k < 0xD800 else k + 0x800)
            chars.append(ch)
        out.append("".join(chars))
    return out


def confirmed(strings: list[str], window: int) -> list[str]:
    """Windows that occur at two places or more of these strings."""
    found: set[str] = set()
    seen: set[str] = set()
    for s in strings:
        for i in range(len(s) - window + 1):
            w = s[i : i + window]
            if w in seen:
                found.add(w)
            else:
                seen.add(w)
    return sorted(found)


def locate(contents: list[bytes], docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, offset, size) of all occurrences of confirmed passages but each passage's first."""
    strings = as_strings(contents)
    passages = confirmed(strings, window)
    hits: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    for base in range(0, len(passages), PASSAGES):
        automaton = ahocorasick.Automaton()
        for k, p in enumerate(passages[base : base + PASSAGES], base):
            automaton.add_word(p, k)
        automaton.make_automaton()
        found = [(k, i, end - window + 1) for i, s in enumerate(strings) for end, k in automaton.iter(s)]
        hits.append(np.array(found, np.int64).reshape(-1, 3))
    passage, row, offset = np.concatenate(hits).T
    doc, start = docs[row], starts[row] + offset
    order = np.lexsort((start, doc, passage))
    passage, row, offset = passage[order], row[order], offset[order]
    later = np.zeros(len(passage), bool)
    later[1:] = passage[1:] == passage[:-1]
    return row[later], offset[later], np.full(int(later.sum()), window)


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g])


def _resolve(window: int):
    def resolve(contents, docs, starts, counts):
        return locate(contents, docs, starts, counts, window)

    return resolve


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **hot: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space)."""

    def finish(b: pa.RecordBatch, texts: Iterator[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        n_words, removed, kept = zip(*[(len(m), int(m.sum()), hashlib.sha256(_kept(t, m)).hexdigest()) for t, m in texts], strict=True)
        columns = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_removed(docs, Units(True, window, gram, **hot), _resolve(window), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", SHARD)


def deduped_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, all columns and rows, with repeated words cut from their texts: words are joined by one space where any
    went, other texts stay as they are."""

    def finish(b: pa.RecordBatch, texts: Iterator[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        there = b.column("text").is_valid().to_pylist()
        cut = [(_kept(t, m) if m.any() else t).decode() if ok else None for (t, m), ok in zip(texts, there, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("row"), pa.array(cut, pa.string())], ["row", "cut"])

    row = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = T.StructType([T.StructField("row", row), T.StructField("cut", T.StringType())])
    cut = with_removed(docs, Units(True, window, gram), _resolve(window), finish, schema, SHARD, carry=True)
    return cut.select(*[F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
