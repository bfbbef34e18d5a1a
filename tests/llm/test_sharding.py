"""Hilbert shards: the curve, and the law of equal rows."""

import zlib

import numpy as np

from pyspark.sql import functions as F

from palisade.llm.sharding import hilbert_index, hilbert_shards, name_cells, size_cell


def test_curve_visits_every_cell_by_single_steps():
    for bits, dims in ((2, 2), (3, 2), (2, 3), (1, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(spark):
    rows = [(i, "t" * (i % 97), ["en", "de", None][i % 3], f"s{i % 7}", 0) for i in range(1000)] + [(None, None, None, None, 0), (5, "t" * 5, "en", "s5", 0), (5, "é", "en", "s5", 0)] + [(5000 + i, "same text", "en", "s0", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = hilbert_shards(docs).toPandas()
    assert sorted(map(str, got.text_crc32)) == sorted(str(zlib.crc32((r[1] or "").encode())) for r in rows)
    assert got["size"].sum() == sum(len((r[1] or "").encode()) + 8 for r in rows)
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert list(counts.index) == list(range(24)) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    spans = got.groupby("shard").curve.agg(["min", "max"])
    assert (spans["min"].to_numpy()[1:] >= spans["max"].to_numpy()[:-1]).all()
    few = hilbert_shards(docs.limit(3)).toPandas()
    assert sorted(few.slot) == [0, 0, 0] and few.shard.nunique() == 3
    assert hilbert_shards(docs.limit(0)).count() == 0


def walk(bits):
    """Cells of the plane in order of Hilbert's own construction: four copies of the smaller curve, the outer ones
    mirrored on the two diagonals."""
    if not bits:
        return [(0, 0)]
    n, small = 1 << (bits - 1), walk(bits - 1)
    return [(y, x) for x, y in small] + [(x, y + n) for x, y in small] + [(x + n, y + n) for x, y in small] + [(2 * n - 1 - y, n - 1 - x) for x, y in small]


def test_index_against_the_recursive_curve():
    for bits in (1, 2, 3, 5):
        cells = walk(bits)
        assert len(set(cells)) == 1 << 2 * bits
        plain, turned = hilbert_index(np.array(cells), bits), hilbert_index(np.array(cells)[:, ::-1], bits)
        assert plain.tolist() == list(range(len(cells))) or turned.tolist() == list(range(len(cells)))


def test_cells_keep_their_order(spark):
    sizes = spark.range(1).select(*[size_cell(F.lit(n)).alias(str(n)) for n in (0, 8, 46_000, 47_000, 100_000, 50_000_000, 2_000_000_000)]).first()
    assert list(sizes) == sorted(sizes) and len(set(sizes[2:])) >= 4 and max(sizes) < 64
    docs = spark.createDataFrame([(f"n{i:04}",) for i in range(500) for _ in range(1 + i % 3)] + [("zz",)] * 900 + [(None,)] * 5, "source string")
    got = sorted((r.name, r.cell) for r in name_cells(docs, "source", 6).collect())
    assert len(got) == 501 and [c for _, c in got] == sorted(c for _, c in got) and got[0][1] == 1 and got[-1][1] <= 63
    assert len({c for _, c in got}) >= 32


def test_pruning(spark):
    """Few shards hold the rows of one value in any dimension; dealt by hash all would."""
    rows = [(i, "t" * (i * 7919 % 3000), "abcdefgh"[i * 31 % 8], f"s{i * 17 % 16:02}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = docs.join(hilbert_shards(docs), "doc_id").select("lang", "source", F.floor(F.log2("size")).alias("octave"), "shard").toPandas()
    for c in ("lang", "source", "octave"):
        assert got.groupby(c).shard.nunique().mean() < 16, c
