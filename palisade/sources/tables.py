"""Traces, manifests, listings, logs and earlier results as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sandbox's trace. A fixed format.
TRACE = (
    "Package struct<Ecosystem:string,Name:string,Version:string>, Analysis map<string,struct<Files:array<struct<Path:string,Read:boolean,Write:boolean,Delete:boolean>>,"
    "Sockets:array<struct<Address:string,Port:int,Hostnames:array<string>>>,Commands:array<struct<Command:array<string>,Environment:array<string>>>,"
    "DNS:array<struct<Class:string,Queries:array<struct<Hostname:string,Types:array<string>>>>>,Status:string>>"
)
OSV = "ecosystem string, name string, version string, id string, summary string, db_severity string, severity array<struct<type:string,score:string>>"
INDEX = "meta map<string,string>, name string, files array<struct<filename:string,url:string,hashes:map<string,string>,`requires-python`:string,yanked:string>>"


def traces(raw: DataFrame) -> DataFrame:
    """digest, ecosystem, trace from digest, ecosystem, json; texts without an analysis are none."""
    parsed = raw.select("digest", "ecosystem", F.from_json("json", TRACE).alias("trace"))
    return parsed.filter("trace.Analysis IS NOT NULL")


def trace_errors(raw: DataFrame) -> DataFrame:
    """digest, error of the texts that are no trace."""
    parsed = raw.withColumn("trace", F.from_json("json", TRACE)).filter("trace.Analysis IS NULL")
    error = F.when(F.try_parse_json("json").isNull(), "behavior: parse trace").otherwise("behavior: trace has no Analysis section")
    return parsed.select("digest", error.alias("error"))


def listed(rows: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """The rows whose name is on a curated list."""
    return rows.join(names.select(F.col("name").alias(key)).distinct(), key, "left_semi")


def unlisted(rows: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """The rows whose name is on no such list; rows without a name too."""
    return rows.join(names.select(F.col("name").alias(key)).distinct(), key, "left_anti")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, name, label, tarball, trace (null for '-') of a tab-separated manifest."""
    line = F.trim("value")
    parts = F.split(F.col("line"), "\t")
    at = lambda i: F.get(parts, F.lit(i))
    rows = spark.read.text(path).select(line.alias("line")).filter("line <> '' AND NOT startswith(line, '#')").filter(F.size(parts) >= 3)
    given = lambda c: F.when(c.isNotNull() & ~c.isin("-", ""), c)
    return rows.select(at(0).alias("ecosystem"), at(1).alias("name"), at(2).alias("label"), given(at(3)).alias("tarball"), given(at(4)).alias("trace"))


def samples(listed: DataFrame, archives: DataFrame, trace_files: DataFrame) -> DataFrame:
    """The manifest with its evidence: content and json joined by path; a sample without any has an error.
    archives: path, content; trace_files: path, json."""
    both = listed.join(archives.select(F.col("path").alias("tarball"), "content"), "tarball", "left").join(trace_files.select(F.col("path").alias("trace"), "json"), "trace", "left")
    error = F.when(F.col("tarball").isNotNull() & F.col("content").isNull(), "tarball: not found").when(F.col("trace").isNotNull() & F.col("json").isNull(), "trace: not found").when(F.col("content").isNull() & F.col("json").isNull(), "no evidence")
    return both.withColumn("error", error)


def pool(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, name, first_seen of a tab-separated pool; short lines are skipped."""
    parts = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).filter(F.size(parts) >= 3)
    return rows.select(parts[0].alias("ecosystem"), parts[1].alias("name"), F.try_to_date(parts[2]).alias("first_seen"))


def dataset_listing(lines: DataFrame, ecosystem: str, kind: str = "malicious_intent") -> DataFrame:
    """ecosystem, name, date of the archives in a dataset's tree: any/any/<kind>/<name>/.../<a name with a date>.zip"""
    parts = F.split(F.trim("value"), "/")
    date = F.regexp_extract(F.element_at(parts, -1), r"(\d{4}-\d{2}-\d{2})", 1)
    rows = lines.filter(F.trim("value").endswith(".zip") & (F.size(parts) >= 5)).filter((parts[2] == kind) & (date != ""))
    return rows.select(F.lit(ecosystem).alias("ecosystem"), parts[3].alias("name"), F.try_to_date(date).alias("date"))


def earlier_results(spark: SparkSession, path: str) -> DataFrame:
    """name, eco, tag, decision, rules (array) of result files in JSON lines."""
    rows = spark.read.schema("name string, eco string, tag string, decision string, rules string").json(path)
    return rows.withColumn("rules", F.filter(F.split(F.coalesce("rules", F.lit("")), ","), lambda r: r != ""))


def sink_log(lines: DataFrame) -> DataFrame:
    """at, src, orig_dst, tls, sni, decrypted, plaintext from the recorder's log lines."""
    v = F.col("value")
    got = lambda p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    rows = lines.filter(v.rlike(r"^[0-9.]+ src=\S+ orig_dst="))
    tls = v.rlike(r"^[0-9.]+ src=\S+ orig_dst=\S+ TLS ")
    return rows.select(got(r"^([0-9.]+) ").cast("double").alias("at"), got(r" src=(\S+)").alias("src"), got(r" orig_dst=(\S+)").alias("orig_dst"), tls.alias("tls"), got(r" TLS sni=(\S+)").alias("sni"), got(r" DECRYPTED=(.*)$").alias("decrypted"), got(r"^[0-9.]+ src=\S+ orig_dst=\S+ plaintext=(.*)$").alias("plaintext"))


def dns_log(lines: DataFrame) -> DataFrame:
    """at, src, name, type, answer from the resolver's log lines."""
    pattern = r"^([0-9.]+) (\S+) (\S+) type=(\S+) -> (\S*)"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.filter(F.col("value").rlike(pattern)).select(part(1).cast("double").alias("at"), part(2).alias("src"), part(3).alias("name"), part(4).alias("type"), part(5).alias("answer"))


def package_index(raw: Column) -> Column:
    """A project's index document as a struct."""
    return F.from_json(raw, INDEX)


def top_names(spark: SparkSession, path: str) -> DataFrame:
    """name, rank: the distinct names of a list, in its order."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"), F.monotonically_increasing_id().alias("rank")).filter("name <> ''")
    return lines.groupBy("name").agg(F.min("rank").alias("rank"))
