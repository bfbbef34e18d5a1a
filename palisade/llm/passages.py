"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded by shares of character kinds, word shapes,
repeats and hashed byte pairs; a gated attention learns from document labels alone which passages matter, and the
weighted mean of the encoded passages is classified. The model is small and is trained on a sample of labelled rows that
is bounded by ROWS_A_LABEL rows and PASSAGES_A_LABEL passages a label: rows are taken in order of a hash, each with all of
its passages, while they fit. Every whole text is scored.

Defined cases: null and empty texts are one empty passage; of rows that share an id the least text teaches; labels that are null or contradict each other teach nothing;
without rows of both labels every score is 0.5; repeated rows get equal scores; an empty table gives an empty result;
other columns are ignored, and lang, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import n_words
from palisade.llm.hashing import mix, word_bounds, word_hashes

PASSAGE, PAIRS, HIDDEN, ATTENTION = 64, 48, 24, 12
ROWS_A_LABEL, PASSAGES_A_LABEL, EPOCHS, SEED = 4000, 100_000, 30, 3

_KIND = np.full(256, 5)  # lower, upper, digit, mark, sign, other (bytes of other scripts)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_KIND[[ord(c) for c in "#*$%&|<>@^~_=+/\\{}[]`"]] = 4
KINDS = 6
WIDTH = KINDS + 8 + PAIRS


def encode(raw: bytes) -> np.ndarray:
    """Features of each passage of a text, (passages, WIDTH)."""
    b = np.frombuffer(raw, np.uint8)
    start, end = word_bounds(b)
    n = len(start)
    if not n:
        out = np.zeros((1, WIDTH), np.float32)
        out[0, KINDS] = 1
        return out
    passages = -(-n // PASSAGE)
    of_word = np.minimum(np.arange(n) // PASSAGE, passages - 1)
    size = end - start
    count = np.bincount(of_word, minlength=passages).astype(np.float32)
    ink = np.repeat(of_word, size)
    at = np.arange(len(ink)) + np.repeat(start - np.cumsum(size) + size, size)
    letters = b[at]
    n_ink = np.bincount(ink, minlength=passages).astype(np.float32)
    kinds = np.bincount(ink * KINDS + _KIND[letters], minlength=passages * KINDS).reshape(passages, KINDS) / n_ink[:, None]
    h = word_hashes(b)
    order = np.lexsort((h, of_word))
    fresh = np.ones(n, bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order][fresh], minlength=passages)
    again = np.zeros(n)
    again[1:] = h[1:] == h[:-1]
    gap = np.zeros(n)
    gap[1:] = np.fromiter((b"\n" in raw[i:j] for i, j in zip(end[:-1].tolist(), start[1:].tolist(), strict=True)), float, n - 1) if b"\n" in raw else 0
    mean = lambda x: np.bincount(of_word, weights=x, minlength=passages) / count
    tail = _KIND[b[end - 1]]
    shape = np.stack([np.zeros(passages), mean(size) / 10, mean(size <= 3), mean(tail == 3), mean(tail == 4), 1 - distinct / count, mean(again), mean(gap)], 1)
    pair = letters[:-1].astype(np.uint64) << np.uint64(8) | letters[1:]
    inside = ink[1:] == ink[:-1]
    bucket = (mix(pair[inside]) % np.uint64(PAIRS)).astype(np.int64)
    pairs = np.bincount(ink[1:][inside] * PAIRS + bucket, minlength=passages * PAIRS).reshape(passages, PAIRS) / n_ink[:, None]
    return np.concatenate([kinds, shape, np.sqrt(pairs)], 1).astype(np.float32)


class Attention:
    """Encoder tanh(x E), gated attention softmax(w (tanh(h V) * sigmoid(h U))), and a linear score of the mean."""

    def __init__(self, width: int, rng: np.random.Generator):
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {"E": draw(width, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags in a row; first: where each bag begins."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        sizes = np.diff(np.append(first, len(x)))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": y, "sizes": sizes}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)["y"]

    def _gradients(self, f: dict[str, np.ndarray], target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        d = weight * (f["y"] - target) / weight.sum()
        dz = d[:, None] * p["c"]
        wide = np.repeat(dz, f["sizes"], axis=0)
        da = (wide * f["h"]).sum(1)
        first = np.cumsum(f["sizes"]) - f["sizes"]
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["sizes"]))
        gate = ds[:, None] * p["w"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * wide + dv @ p["V"].T + du @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ de, "e": de.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> Attention:
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 1e-3
        share = np.array([1 / max(1, (labels == k).sum()) for k in (0, 1)])  # both labels weigh the same
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                sizes = np.array([len(bags[i]) for i in rows])
                g = self._gradients(self._forward(np.concatenate([bags[i] for i in rows]), np.cumsum(sizes) - sizes), labels[rows], share[labels[rows].astype(int)])
                step += 1
                for k, x in g.items():
                    x = x + decay * self.p[k]
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """The fold that never teaches: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bags(docs: DataFrame, labels: DataFrame, rows: int, seed: int, passages: int = PASSAGES_A_LABEL) -> pd.DataFrame:
    """label and encoded passages of the training sample: up to rows documents a label, in order of a hash, while their
    passages fit in the bound. Of rows that share an id the one with the least text teaches."""
    sure = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).filter("label = most")
    key = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = sure.filter("label = 0").orderBy(*key).limit(rows).unionByName(sure.filter("label = 1").orderBy(*key).limit(rows)).select(F.col("doc_id").cast("long").alias("id"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text"):
                raw = text.as_buffer()
                out.append(encode(b"" if raw is None else raw.to_pybytes()).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(out, pa.binary())], ["id", "label", "bag"])

    # the sample is bounded by its limits: few rows enter the windows, and few passages leave them
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    found = found.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    held = F.sum(F.ceil(F.greatest(n_words(F.col("text")), F.lit(1)) / PASSAGE)).over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    found = found.withColumn("held", held).filter(F.col("held") <= passages).select("id", "label", "text")
    return found.mapInArrow(run, "id long, label int, bag binary").toPandas().sort_values("id", ignore_index=True)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_A_LABEL, seed: int = SEED, passages: int = PASSAGES_A_LABEL) -> Attention | None:
    sample = bags(docs, labels, rows, seed, passages)
    if sample["label"].nunique() < 2:
        return None
    rng = np.random.default_rng(seed)
    return Attention(WIDTH, rng).fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in sample["bag"]], sample["label"].to_numpy(float), rng)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = ROWS_A_LABEL, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted."""
    model = train(docs, labels, rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = []
            for text in b.column("text"):
                raw = text.as_buffer()
                score.append(float(model.score(encode(b"" if raw is None else raw.to_pybytes()), np.zeros(1, np.int64))[0]) if model else 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
