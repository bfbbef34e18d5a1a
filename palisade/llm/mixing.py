"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are range-sorted within each source, words are summed by distributed
prefix sums (per key range first, then inside each range), and each source is cut at its exact budget; a budget above
the source's size repeats whole epochs first. Only DataFrame functions; no task ever holds a whole source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 has
target 0 and takes nothing; a null id has a key of its text; texts of any length count whole; ties of keys go by id, then
size, and rows equal in these are interchangeable, so reruns agree; repeated rows are documents of their own; an empty
table gives an empty mix; other columns are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize, n_words, rest_of_row, text_name

#: Hex digits of the key that name its range: 16**3 ranges a source.
RANGE_DIGITS = 3


def _source_key(source: Column) -> Column:
    """Non-null join key that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def targets(sizes: DataFrame, cycle: int = 3, cap: int = 3) -> DataFrame:
    """Word target of each source. sizes: sk, source_size.

    Weights run 1..cycle in source order. All sizes are shared by weight; a target stops at cap times its source's
    size, and the excess goes to the rest by weight. Sources fill up in order of cap / weight, so one pass of running
    sums gives the level at which each would fill, and the first that does not fill sets the level of the rest.
    The table has a row a source, so its windows are small.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("sk")
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "sk")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(cycle)) + 1)
        .withColumn("limit", cap * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
        .withColumn("rest", F.min(F.struct(F.col("full"), F.col("limit") / F.col("weight"), F.col("sk"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("rest.level")))
        .select("sk", "source_size", "target")
    )


def mix(docs: DataFrame, seed: str = "mix", cycle: int = 3, cap: int = 3, whole: bool = False, row: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes of each document, repeats counted.

    The document that crosses its source's budget is taken in part, up to the exact word; with whole=True it is taken
    whole if at least half of it fits. row: one more column to carry, as `row`.
    """
    carried = [row.alias("row")] if row is not None else []
    slim = docs.select(
        "doc_id", n_words(F.col("text")).alias("size"), _source_key(F.col("source")).alias("sk"), *carried,
        # rows without an id are dealt by their text
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.col("text"), F.lit("")))))).alias("key"),
    )
    slim = materialize(slim.withColumn("range", F.substring("key", 1, RANGE_DIGITS)))

    ranges = slim.groupBy("sk", "range").agg(F.sum("size").alias("words"))
    plan = targets(ranges.groupBy("sk").agg(F.sum("words").alias("source_size")), cycle, cap)
    earlier = Window.partitionBy("sk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").join(plan, "sk")

    inside = Window.partitionBy("sk", "range").orderBy("key", "doc_id", "size", *(["row"] if carried else [])).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    return (
        slim.join(offsets, ["sk", "range"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("room", budget - F.col("epochs") * F.col("source_size") - F.col("before"))
        .withColumn("part", F.when(F.col("size") <= 2 * F.col("room"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least("room", "size")))
        .select("doc_id", *(["row"] if carried else []), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: docs with each row repeated as often as the mix takes it (not at all: gone). Documents stay
    whole, and one with no words goes. All columns are kept, whatever their names."""
    key = text_name(F.to_json(F.struct("doc_id", "source")), F.col("text"))
    times = mix(docs.select("doc_id", "text", "source"), seed, whole=True, row=key).filter("taken > 0")
    times = times.groupBy(F.col("row").alias("k")).agg(F.sum(F.expr("taken div size")).alias("times"), F.count("*").alias("rows"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), rest_of_row(docs.columns, "doc_id", "text", "source").alias("rest"))
    # rows equal in id, text and source share their times: the first ones, by their other columns, get what doesn't divide
    nth = F.row_number().over(Window.partitionBy("key").orderBy("rest"))
    found = packed.withColumn("nth", nth).join(times, F.col("key") == F.col("k"))
    share = F.expr("times div rows + if(nth <= times % rows, 1, 0)")
    return found.filter(share > 0).select("row", F.explode(F.array_repeat(F.lit(1), share.cast("int"))).alias("copy")).select("row.*")
