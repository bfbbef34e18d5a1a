"""What a sandbox leaves behind: a folder a sample with its trace, system-call logs, written bytes and static results.

Folders are listed by Spark. Contents are read only where they are asked for, and only of the files that count.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.packages import KEPT

#: Paths below a sample's folder, as the sandbox writes them and as they are archived. Fixed values.
KINDS = {
    "trace": r"results\.json",
    "strace": r"l/[^/]+/runsc\.log\.boot|strace\.log\.gz",
    "writes": r"fw/write_buffers_\.zip|write_buffers\.zip",
    "static": r"s/results\.json|static\.json",
}
#: The line of a log that tells of an installation. A fixed value.
INSTALLED = "Install succeeded"


def _root(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """name, kind, path, length, content of the files that have a kind; content is read only if it is used."""
    below = F.substring("path", len(_root(spark, root)) + 2, 1 << 20)
    rest = F.regexp_replace(below, r"^[^/]+/", "")
    kind = F.coalesce(*[F.when(rest.rlike(f"^(?:{p})$"), k) for k, p in KINDS.items()])
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.regexp_extract(below, r"^([^/]+)/", 1).alias("name"), kind.alias("kind"), "path", "length", "content").filter("kind IS NOT NULL AND name <> ''")


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """name, kind, path, length: of each kind a sample's largest file, of equal ones the last by path. A sample may have
    several system-call logs, one a phase; the largest is the one that tells."""
    rows = _listed(spark, root).drop("content")
    last = F.max(F.struct("length", "path")).alias("f")
    return rows.groupBy("name", "kind").agg(last).select("name", "kind", "f.path", "f.length")


def sandbox_traces(spark: SparkSession, root: str, ecosystem: str) -> DataFrame:
    """digest (the sample's name), ecosystem, json of the traces, for `tables.traces` and `tables.trace_errors`."""
    rows = _listed(spark, root).filter("kind = 'trace'")
    return rows.select(F.col("name").alias("digest"), F.lit(ecosystem).alias("ecosystem"), F.col("content").cast("string").alias("json"))


def syscall_lines(spark: SparkSession, root: str) -> DataFrame:
    """name, value: the lines of each sample's largest system-call log, compressed or not."""
    meant = outputs(spark, root).filter("kind = 'strace'").select("name", "path")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{runsc.log.boot,strace.log.gz}").text(root)
    return lines.select("value", _plain(F.col("_metadata.file_path")).alias("path")).join(meant.withColumn("path", F.regexp_replace("path", r"^file:/+", "/")), "path").select("name", "value")


def _plain(uri: Column) -> Column:
    """A file's URI as its path."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")


def written_files(spark: SparkSession, root: str) -> DataFrame:
    """name, member, size, content (its first KEPT bytes), error: the bytes that samples wrote. An archive that doesn't
    open is one row with an error; members leave one at a time."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["name"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                with z.open(m) as f:
                                    yield pd.DataFrame({"name": [name], "member": [m.filename], "size": [m.file_size], "content": [f.read(KEPT)], "error": [None]})
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError) as e:
                    yield pd.DataFrame({"name": [name], "member": [None], "size": [None], "content": [None], "error": [str(e) or type(e).__name__]})

    rows = _listed(spark, root).filter("kind = 'writes'").select("name", "content")
    return rows.mapInPandas(members, "name string, member string, size long, content binary, error string")


def installs(spark: SparkSession, root: str) -> DataFrame:
    """name, install_ok: how many lines of each log <name>.log tell of an installation."""
    lines = spark.read.option("pathGlobFilter", "*.log").text(root)
    name = F.regexp_extract(_plain(F.col("_metadata.file_path")), r"([^/]+)\.log$", 1)
    return lines.groupBy(name.alias("name")).agg(F.count_if(F.col("value").contains(INSTALLED)).alias("install_ok"))


def outcomes(samples: DataFrame, traces: DataFrame, decided: DataFrame, installed: DataFrame) -> DataFrame:
    """name, decision, rules, install_ok for `write_results`: samples without a trace are NO_TRACE. samples: name;
    traces: digest; decided: digest, decision, signals; digests are names here."""
    counted = F.filter("signals", lambda s: s["severity"].isin("medium", "high", "critical"))
    rules = F.array_join(F.array_sort(F.array_distinct(F.transform(counted, lambda s: F.concat_ws(":", s["stage"], s["rule"])))), ",")
    rows = samples.select("name").distinct().join(traces.select(F.col("digest").alias("name"), F.lit(True).alias("traced")).distinct(), "name", "left")
    rows = rows.join(decided.select(F.col("digest").alias("name"), "decision", rules.alias("rules")), "name", "left").join(installed, "name", "left")
    decision = F.when(F.col("traced").isNull(), "NO_TRACE").otherwise(F.coalesce("decision", F.lit("ERR")))
    return rows.select("name", decision.alias("decision"), F.when(F.col("traced"), F.coalesce("rules", F.lit(""))).otherwise("").alias("rules"), F.when(F.col("traced"), F.coalesce("install_ok", F.lit(0))).otherwise(0).alias("install_ok"))
