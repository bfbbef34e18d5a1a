"""Command lines: `python -m palisade score` for one package, `python -m palisade evaluate` for a manifest of samples."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.deploy import ship
from palisade.operators.decide import Policy, policies
from palisade.operators.triage import RuleModel
from palisade.plans import reports, scoring
from palisade.sources import packages, sinks, tables
from palisade.sources.scratch import cut

#: Exit codes of a call that can't be answered. Fixed values.
FAILED, MISUSED = 1, 2


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palisade")
    sub = top.add_subparsers(dest="command", required=True)
    score = sub.add_parser("score", help="the verdict on one package, as JSON; exits with 0, 3 or 4 for allow, quarantine or block")
    score.add_argument("--trace", help="the sandbox's trace")
    score.add_argument("--tarball", help="the package's archive")
    score.add_argument("--ecosystem", default="npm")
    score.add_argument("--name", default="")
    score.add_argument("--version", default="")
    score.add_argument("--triage", choices=("off", "mock"), default="off", help="a model's opinion; other models are given in code")
    evaluate = sub.add_parser("evaluate", help="recall and false positives over a manifest")
    evaluate.add_argument("--manifest", required=True, help="tab-separated ecosystem, name, label, tarball, trace; '-' for none")
    evaluate.add_argument("--root", required=True, help="the folder that holds all archives and traces; paths are below it")
    evaluate.add_argument("--mode", choices=reports.MODES, default="report")
    evaluate.add_argument("--json", action="store_true", help="the report as JSON")
    for p in (score, evaluate):
        for severity in ("critical", "high", "medium"):
            p.add_argument(f"--{severity}-quorum", type=int, default=0)
        p.add_argument("--disable-rule", default="", help="names, separated by commas")
        p.add_argument("--fail-closed", action="store_true")
    return top


def policy(a: argparse.Namespace) -> Policy:
    off = tuple(sorted({r.strip() for r in a.disable_rule.split(",")} - {""}))
    return Policy(critical_quorum=a.critical_quorum, high_quorum=a.high_quorum, medium_quorum=a.medium_quorum, fail_closed=a.fail_closed, disabled=off)


def scored(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    """The verdict on one package as JSON, and the exit code. A package known by its trace only has no digest."""
    archive = Path(a.tarball).read_bytes() if a.tarball else None
    trace = Path(a.trace).read_bytes() if a.trace else None
    one = spark.createDataFrame([("", a.ecosystem, a.name, a.version, None, archive, trace)], "digest string, ecosystem string, name string, version string, filename string, content binary, behavior_log binary")
    if archive is not None:
        one = one.withColumn("digest", packages.digest(F.col("content")))
    one = cut(one)
    artifacts, rules = one.select("digest", "ecosystem", "name", "version"), policies(spark, policy(a))
    files = packages.files_of(packages.unpacked(one.filter("content IS NOT NULL")))
    traces = tables.traces(one.filter("behavior_log IS NOT NULL").select("digest", "ecosystem", F.col("behavior_log").cast("string").alias("json")))
    if a.triage == "mock":
        judged = scoring.score_with_model(artifacts, files, traces, one.select("digest", "behavior_log"), RuleModel(), rules)
    else:
        judged = scoring.score(artifacts, files, traces, rules)
    judged = cut(judged)
    document = json.loads(sinks.sealed(judged).first().document)
    return json.dumps(document, indent=2, ensure_ascii=False), judged.select(sinks.exit_code(F.col("decision")).alias("code")).first().code


def evidence(spark: SparkSession, manifest: str, root: str) -> tuple[DataFrame, DataFrame]:
    """samples and findings of a manifest. Samples without their evidence have an error and no findings; a sample that
    is listed twice counts twice and is analysed once."""
    root = root.rstrip("/")
    below = lambda c: F.when(F.startswith(c, F.lit(root + "/")), F.substring(c, len(root) + 2, 1 << 20)).otherwise(c)
    listed = tables.manifest(spark, manifest)
    for c in ("tarball", "trace"):
        listed = listed.withColumn(c, below(F.col(c)))
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    start = len(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()) + 2
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring("path", start, 1 << 20).alias("path"), "content")
    key = F.sha2(F.concat_ws("\t", *[F.coalesce(c, F.lit("-")) for c in ("ecosystem", "name", "label", "tarball", "trace")]), 256)
    rows = cut(tables.samples(listed, held, held.select("path", F.col("content").cast("string").alias("json"))).withColumn("digest", key).withColumn("filename", F.lit(None).cast("string")))
    once = rows.filter("error IS NULL").dropDuplicates(["digest"])
    files = cut(packages.files_of(packages.unpacked(once.filter("content IS NOT NULL"))))
    return rows.select("digest", "name", "label", "error"), cut(scoring.signals(files, tables.traces(once.filter("json IS NOT NULL"))))


def main(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "score" and not (a.trace or a.tarball):
        print("palisade score: give --trace, --tarball or both")
        return MISUSED
    spark = SparkSession.builder.appName("palisade").getOrCreate()
    ship(spark)
    if a.command == "score":
        try:
            document, code = scored(spark, a)
        except OSError as e:
            print(f"palisade score: {e}")
            return FAILED
        print(document)
        return code
    samples, findings = evidence(spark, a.manifest, a.root)
    if a.json and a.mode == "report":
        print(json.dumps(json.loads(reports.report_json(samples, findings, policy(a)).first().document), indent=2))
    else:
        for line in reports.text(reports.views(samples, findings, a.mode, policy(a))):
            print(line)
    return 0
