"""BPE encoding and decoding with a public byte-level vocabulary.

Encoder: an Aho-Corasick automaton of all tokens finds the longest token that starts at each byte; a chain of such
tokens is extended while neighbours are compatible, that is while the merge rules would not have joined across their
border, and backs up to the next shorter token otherwise. The chain that reaches the end is the exact result of the
merges, in time linear in the piece. Compatibility is decided from the merge tree and kept in a bounded table.
Decoder: one byte string of all tokens and a table of offsets.

Defined cases: null and empty texts have no tokens; a special token's string in a text is that token, as in the
tokenizer file; pieces of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The byte-level split pattern of the public tokenizer format. A fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bounds of a worker's tables, in entries.
KEPT_PIECES, KEPT_PAIRS, KEPT_LENGTH = 400_000, 1_000_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the public byte-level format, by the format's rule: printable Latin-1
    characters stand for themselves, the other bytes count up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.token = [b""] * n
        for b, i in ids.items():
            self.token[i] = b
        for s, i in self.special.items():
            self.token[i] = s.encode()
        #: Rank of the merge that makes a token; bytes come before all merges.
        self.rank = [-1] * n
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            made = ids[a + b]
            self.pair_rank.setdefault((ids[a], ids[b]), rank)
            if self.parts[made] is None:
                self.parts[made], self.rank[made] = (ids[a], ids[b]), rank
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * n
        for b, i in ids.items():
            if b:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        for b, i in ids.items():  # the longest proper prefix that is a token
            for k in range(len(b) - 1, 0, -1):
                if b[:k] in ids:
                    self.shorter[i] = ids[b[:k]]
                    break
        self.length = [len(b) for b in self.token]
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.ends = np.cumsum(self.length)
        self.starts = self.ends - self.length
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, str, bytes]] = {}
        self.split = regex.compile(PIECES).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """True if no merge rule ever joins across the border of a and b while the merges build both.

        Merges go by rank, the leftmost of equal ones first. Undo them from the last to the first, keeping the tokens
        that touch the border: a rule for these two fires if it ranks before the merge that takes the left one into a
        larger token, and not after the merge that takes the right one.
        """
        rank, parts, pair_rank = self.rank, self.parts, self.pair_rank
        used_a = used_b = len(pair_rank)
        while True:
            joins = pair_rank.get((a, b))
            if joins is not None and joins < used_a and joins <= used_b:
                return False
            if parts[b] is None or (parts[a] is not None and rank[a] > rank[b]):
                if parts[a] is None:
                    return True
                used_a, a = rank[a], parts[a][1]
            else:
                used_b, b = rank[b], parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        size = [0] * n
        for end, (k, i) in self.automaton.iter(piece.decode("latin-1")):
            s = end - k + 1
            if k > size[s]:
                size[s], longest[s] = k, i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + self.length[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif (token := self.shorter[token]) < 0:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
                while token < 0:
                    dead[at] = 1
                    token = out.pop()
                    at -= self.length[token]
                    token = self.shorter[token]

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.encode_piece(piece.encode())
        made = (len(ids), ",".join(map(str, ids)), np.array(ids, np.int32).tobytes())
        if len(piece) <= KEPT_LENGTH:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[piece] = made
        return made

    def _encoded(self, text: str) -> list[tuple[int, str, bytes]]:
        out: list[tuple[int, str, bytes]] = []
        get, make = self.pieces.get, self._piece
        for k, run in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                i = self.special[run]
                out.append((1, str(i), np.array([i], np.int32).tobytes()))
            else:
                out += [get(p) or make(p) for p in self.split(run)]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(x[2] for x in self._encoded(text or "")), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered through the offset table."""
        if not len(ids):
            return b""
        first, last = self.starts[ids], self.ends[ids]
        sizes = last - first
        jump = np.ones(int(sizes.sum()), np.int64)
        jump[0] = first[0]
        jump[np.cumsum(sizes)[:-1]] = first[1:] - last[:-1] + 1
        return self.bytes[np.cumsum(jump)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Token count, hash of the ids, hash of the decoded text."""
        found = self._encoded(text or "")
        ids = np.frombuffer(b"".join(x[2] for x in found), np.int32)
        return len(ids), hashlib.sha256(",".join(x[1] for x in found).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary in this process, read once."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for t in _slices(b):
                ids = [bpe.encode(x) for x in t.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for t in _slices(b):
                rows = [bpe.digest(x) for x in t.column("text").to_pylist()]
                n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
