"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, in order, the rows are range-sorted by their index on the Hilbert curve through that
grid, and the sorted run is cut into shards of equal row counts (at most one apart), so that neighbouring rows in every
dimension meet in one shard and files can be pruned by any of them.

Defined cases: a null text has no bytes and the checksum of the empty string; null metadata take cell 0; sizes of any
text, however long, have a cell of their half octave; equal rows are interchangeable; an empty table has no shards in use; fewer rows than shards leave shards empty; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (n, dims), each in [0, 2**bits). Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_column(cells: list[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], 1), bits))

    return index(*cells)


def name_cells(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """name, cell: names in order share the cells 1 and up by their rows, so that equal shares of the rows lie in equal
    ranges of cells. A row a name, so the window is as small as names are few."""
    counts = docs.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("rows")).filter("name IS NOT NULL")
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    cells = (1 << bits) - 1
    placed = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("total", F.sum("rows").over(Window.partitionBy()))
    # written, so Spark knows its size and broadcasts it only if that is small
    return materialize(placed.select("name", (1 + F.expr(f"before * {cells}L div total")).cast("int").alias("cell")))


def size_cell(size: Column) -> Column:
    """Half-octave cell of a size: below 64 for any size that a text can have."""
    return F.floor(2 * F.log2(size + 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) and curve, the Hilbert index.

    Dimensions: source, language and size, in cells of at least 6 bits that keep their order. Global ranks come from one range sort: row numbers inside each range
    partition plus the counts of the partitions before it, a table of one row a partition.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    slim = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source", "lang", size_cell(size).alias("c"))
    for column, cell in (("source", "a"), ("lang", "b")):
        names = name_cells(docs, column, bits).select(F.col("name").alias(column), F.col("cell").alias(cell))
        slim = slim.join(names, column, "left").fillna(0, [cell])
    curved = slim.select("doc_id", "size", "text_crc32", hilbert_column([F.col("a"), F.col("b"), F.col("c")], bits).alias("curve"))
    order = ["curve", "tie", "doc_id", "size", "text_crc32"]
    curved = materialize(curved.withColumn("tie", F.xxhash64("doc_id")))  # spreads the rows of one crowded cell
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = curved.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed)

    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).orderBy("part").collect()  # a row a partition
    first, total = {}, 0
    for c in counts:
        first[c.part] = total
        total += c.rows
    starts = spark.createDataFrame([(k, v) for k, v in first.items()] or [(0, 0)], "part long, first long")
    rank = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    n = max(total, 1)
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(starts), "part")
        .withColumn("rank", rank)
        .withColumn("shard", F.expr(f"rank * {shards}L div {n}L").cast("int"))
        .withColumn("slot", F.col("rank") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
