"""Version differences, the last known-good version, and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.scalars import truncate
from palisade.operators.static_rules import npm_hooks


def previous_good(candidates: DataFrame, history: DataFrame, readable: DataFrame | None = None, carry: str | None = None) -> DataFrame:
    """digest, prev_version, prev_digest: of each candidate the latest earlier version that was allowed, has other bytes
    and (if readable is given) can still be unpacked. carry: one more column of the candidates to keep.

    candidates: ecosystem, name, digest, seq; history: ecosystem, name, version, digest, decision, seq. One as-of
    window over both, with the entries that can't be meant filtered out first.
    """
    good = history.filter("decision = 'allow'")
    if readable is not None:
        good = good.join(readable.select("digest").distinct(), "digest", "left_semi")
    kept = F.lit(None) if carry is None else F.col(carry)
    asks = candidates.select("ecosystem", "name", "seq", F.lit(1).alias("is_candidate"), F.col("digest").alias("candidate"), kept.alias("kept"), F.lit(None).cast("struct<version:string,digest:string>").alias("good"))
    entries = good.select("ecosystem", "name", "seq", F.lit(0).alias("is_candidate"), F.lit(None).cast("string").alias("candidate"), F.lit(None).cast(asks.schema["kept"].dataType).alias("kept"), F.struct("version", "digest").alias("good"))
    before = Window.partitionBy("ecosystem", "name").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    # the latest good entry, and the latest of another digest than that: one of the two differs from the candidate
    both = entries.unionByName(asks).withColumn("last", F.last("good", ignorenulls=True).over(before))
    changed = F.when(F.col("good").isNotNull() & (F.col("last.digest") != F.col("good.digest")), F.col("last"))
    both = both.withColumn("turned", changed).withColumn("other", F.last("turned", ignorenulls=True).over(before))
    asked = both.filter("is_candidate = 1").withColumn("prev", F.when(F.col("last.digest") != F.col("candidate"), F.col("last")).otherwise(F.col("other")))
    return asked.filter("prev IS NOT NULL").select(F.col("candidate").alias("digest"), F.col("prev.version").alias("prev_version"), F.col("prev.digest").alias("prev_digest"), *([] if carry is None else [F.col("kept").alias(carry)]))


def _sides(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the previous and of the current side of each pair, both under the current digest."""
    current = pairs.select("digest").join(rows, "digest")
    previous = pairs.select(F.col("digest").alias("to"), F.col("prev_digest").alias("digest")).join(rows, "digest").drop("digest").withColumnRenamed("to", "digest")
    return previous, current


def file_changes(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """digest, path, change in added, removed, modified: a full outer join on the path, contents compared by hash.
    Only the kept part of a large file counts; of duplicate paths the last in the archive."""
    hashed = files.groupBy("digest", "path").agg(F.max_by("content", "file_idx").alias("content")).select("digest", "path", F.sha2("content", 256).alias("hash"))
    previous, current = _sides(pairs, hashed)
    both = current.withColumnRenamed("hash", "now").join(previous.withColumnRenamed("hash", "old"), ["digest", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old") != F.col("now"), "modified")
    return both.withColumn("change", change).filter("change IS NOT NULL").select("digest", "path", "change")


def diff_summary(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """digest, prev_version, added, removed, modified: sorted paths. An artifact has a bounded number of files."""
    of = lambda c: F.sort_array(F.collect_list(F.when(F.col("change") == c, F.col("path")))).alias(c)
    lists = changes.groupBy("digest").agg(of("added"), of("removed"), of("modified"))
    empty = F.array().cast("array<string>")
    return pairs.join(lists, "digest", "left").select("digest", "prev_version", *[F.coalesce(c, empty).alias(c) for c in ("added", "removed", "modified")])


def _told(rows: DataFrame, key: str, evidence: Column, n: int, name: Column | None = None) -> DataFrame:
    rule, severity, description = fixed.DIFF_RULES[key]
    told = F.lit(description) if name is None else F.format_string(description.replace("{}", "%s"), name)
    return rows.select("digest", F.lit("diff").alias("stage"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), told.alias("description"), evidence.alias("evidence"), F.lit(10**12 + n).cast("long").alias("ord"))


def hook_changes(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """New and changed install hooks; a removed one is no finding."""
    previous, current = _sides(pairs, npm_hooks(files))
    both = current.join(previous.select("digest", "hook", F.col("command").alias("old")), ["digest", "hook"], "left")
    evidence = truncate(F.col("command"), 200, trim=False)
    added = _told(both.filter("old IS NULL"), "hook-added", evidence, 0, F.col("hook"))
    return added.unionByName(_told(both.filter("old <> command"), "hook-changed", evidence, 1, F.col("hook")))


def setup_changes(pairs: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """A root setup.py that is new, or else changed."""
    python = files.filter("ecosystem = 'pypi'").select("digest").distinct()
    found = changes.filter("path = 'setup.py'").join(python, "digest", "left_semi")
    evidence = F.lit("setup.py")
    return _told(found.filter("change = 'added'"), "setup-added", evidence, 2).unionByName(_told(found.filter("change = 'modified'"), "setup-changed", evidence, 3))


def diff_findings(pairs: DataFrame, files: DataFrame) -> DataFrame:
    return hook_changes(pairs, files).unionByName(setup_changes(pairs, files, file_changes(pairs, files)))


def append_history(history: DataFrame, entries: DataFrame) -> DataFrame:
    """history with the entries appended; an artifact's first entry stays, later ones of the same digest go."""
    both = history.withColumn("new", F.lit(0)).unionByName(entries.withColumn("new", F.lit(1)))
    first = Window.partitionBy("ecosystem", "name", "digest").orderBy("new", "seq")
    return both.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth", "new")
