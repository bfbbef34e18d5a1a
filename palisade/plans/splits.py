"""Leak-free splits: campaigns of packages, and train and test sets that no campaign straddles.

pool: ecosystem, name, first_seen (a date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scalars import campaign_prefix
from palisade.sources.scratch import cut

BULK_DAY, PREFIX_TOKENS, PREFIX_GROUP = 10, 2, 3
KEY = ["ecosystem", "name"]


def earliest_dates(listing: DataFrame) -> DataFrame:
    """ecosystem, name, first_seen: the earliest date of each package in a listing of (ecosystem, name, date)."""
    return listing.groupBy(*KEY).agg(F.min("date").alias("first_seen"))


def bulk_days(pool: DataFrame, least: int = BULK_DAY) -> DataFrame:
    return pool.groupBy("ecosystem", "first_seen").agg(F.count("*").alias("n"), F.min("name").alias("head")).filter(F.col("n") >= least)


def prefix_groups(pool: DataFrame, least: int = PREFIX_GROUP) -> DataFrame:
    keyed = pool.withColumn("prefix", campaign_prefix(F.col("name"), PREFIX_TOKENS)).filter("prefix IS NOT NULL")
    return keyed.groupBy("ecosystem", "prefix").agg(F.count("*").alias("n"), F.min("name").alias("head")).filter(F.col("n") >= least)


def campaigns(pool: DataFrame, bulk: int = BULK_DAY, group: int = PREFIX_GROUP) -> DataFrame:
    """ecosystem, name, campaign_id: packages of one bulk day or one name family belong together, and so on through
    both; the id is the least name of the component.

    A package has one day and one family, so labels travel between packages, days and families: each round takes the
    least label of each day and family back to its members, by two aggregates, until no label changes.
    """
    day = bulk_days(pool, bulk).select("ecosystem", "first_seen", F.col("first_seen").alias("day"))
    family = prefix_groups(pool, group).select("ecosystem", F.col("prefix").alias("family"))
    now = (
        pool.select(*KEY, "first_seen").distinct().join(day, ["ecosystem", "first_seen"], "left")
        .withColumn("family", campaign_prefix(F.col("name"), PREFIX_TOKENS)).join(family.withColumn("known", F.lit(True)), ["ecosystem", "family"], "left")
        .select(*KEY, "day", F.when(F.col("known"), F.col("family")).alias("family"), F.col("name").alias("label"))
    )
    now = cut(now)
    while True:
        by_day = now.filter("day IS NOT NULL").groupBy("ecosystem", "day").agg(F.min("label").alias("d"))
        by_family = now.filter("family IS NOT NULL").groupBy("ecosystem", "family").agg(F.min("label").alias("f"))
        by_name = now.groupBy(*KEY).agg(F.min("label").alias("s"))
        new = now.join(by_day, ["ecosystem", "day"], "left").join(by_family, ["ecosystem", "family"], "left").join(by_name, KEY)
        new = cut(new.select(*KEY, "day", "family", F.least("label", "d", "f", "s").alias("next"), "label"))
        changed = not new.filter("next <> label").isEmpty()
        now = new.select(*KEY, "day", "family", F.col("next").alias("label"))
        if not changed:
            return now.groupBy(*KEY).agg(F.min("label").alias("campaign_id"))


def campaign_stats(clusters: DataFrame) -> DataFrame:
    """packages, campaigns, in_multi, multi."""
    sizes = clusters.groupBy("ecosystem", "campaign_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("packages"), F.count("*").alias("campaigns"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_multi"), F.count_if(F.col("n") > 1).alias("multi"))


def largest_campaigns(clusters: DataFrame, top: int = 5) -> DataFrame:
    return clusters.groupBy("ecosystem", "campaign_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ecosystem", "campaign_id").limit(top)


def years(pool: DataFrame) -> DataFrame:
    return pool.groupBy(F.date_format("first_seen", "yyyy").alias("year")).agg(F.count("*").alias("n"))


def temporal_split(pool: DataFrame, clusters: DataFrame, cutoff: str) -> DataFrame:
    """pool with campaign_id and side: train before the cutoff, test from it on; a campaign that has a package in train
    is in train as a whole (moved tells)."""
    keyed = pool.join(clusters, KEY)
    early = keyed.filter(F.col("first_seen") < F.lit(cutoff).cast("date")).select("ecosystem", "campaign_id").distinct().withColumn("early", F.lit(True))
    late = F.col("first_seen") >= F.lit(cutoff).cast("date")
    both = keyed.join(early, ["ecosystem", "campaign_id"], "left")
    return both.select(*KEY, "first_seen", "campaign_id", F.when(late & F.col("early").isNull(), "test").otherwise("train").alias("side"), (late & F.col("early").isNotNull()).alias("moved"))


def leaks(split: DataFrame) -> DataFrame:
    """Campaigns on both sides; empty for a sound split."""
    of = lambda s: split.filter(F.col("side") == s).select("ecosystem", "campaign_id")
    return of("train").intersect(of("test"))


def campaign_slice(pool: DataFrame, clusters: DataFrame, number: int = 1, sizes: dict[str, int] | None = None, strict_compat: bool = False) -> DataFrame:
    """The number-th disjoint slice of each ecosystem, in the order of the campaigns' hashes.

    By default a campaign is whole: it is in the slice that its first member falls into. With strict_compat members are
    counted one by one, so a slice has exactly its size and a campaign may straddle two.
    """
    sizes = sizes or {"npm": 120, "pypi": 30}
    keyed = pool.join(clusters, KEY).withColumn("hash", F.md5(F.concat_ws("/", "ecosystem", "campaign_id")))
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("ecosystem")]
    counts = keyed.groupBy("ecosystem", "hash").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ecosystem").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.join(counts.withColumn("before", before), ["ecosystem", "hash"])
    nth = F.row_number().over(Window.partitionBy("ecosystem", "hash").orderBy("name")) - 1
    at = F.col("before") + nth if strict_compat else F.col("before")
    return placed.withColumn("at", at).withColumn("size", size).filter((F.col("at") >= F.col("size") * (number - 1)) & (F.col("at") < F.col("size") * number)).select(*KEY, "first_seen", "campaign_id")


def page(manifest: DataFrame, offset: int, limit: int, order: str = "line") -> DataFrame:
    """Rows offset .. offset + limit of an ordered manifest."""
    return manifest.orderBy(order).offset(offset).limit(limit)
