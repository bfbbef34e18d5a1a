"""Decisions: findings under policies.

A policy is a row: policy, critical_quorum, high_quorum, medium_quorum, fail_closed, disabled (rules that don't count),
overrides (severity by rule), allow_all. Findings are counted once per (policy, artifact) with partial sums; only the
counts, the total and the worst finding leave the aggregate, so many policies over one findings table cost little.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.scalars import severity_rank

POLICY = "policy string, critical_quorum int, high_quorum int, medium_quorum int, fail_closed boolean, disabled array<string>, overrides map<string,string>, allow_all boolean"
DEFAULT_QUORUMS = {"critical": 1, "high": 1, "medium": 2}


@dataclass(frozen=True)
class Policy:
    """Thresholds and exceptions; a quorum that isn't positive means the default."""

    name: str = "default"
    critical_quorum: int = 0
    high_quorum: int = 0
    medium_quorum: int = 0
    fail_closed: bool = False
    disabled: tuple[str, ...] = ()
    overrides: dict[str, str] = field(default_factory=dict)
    allow_all: bool = False

    def row(self) -> tuple:
        return (self.name, self.critical_quorum, self.high_quorum, self.medium_quorum, self.fail_closed, list(self.disabled), dict(self.overrides), self.allow_all)


def policies(spark: SparkSession, *given: Policy) -> DataFrame:
    return spark.createDataFrame([p.row() for p in given or (Policy(),)], POLICY)


def quorum_grid(spark: SparkSession, critical: tuple = (1, 2), high: tuple = (1, 2, 3), medium: tuple = (1, 2, 3, 4)) -> DataFrame:
    """A policy for each point of the sweep."""
    return policies(spark, *[Policy(f"{c},{h},{m}", c, h, m) for c in critical for h in high for m in medium])


def quorum(value: Column, severity: str) -> Column:
    return F.when(F.coalesce(value, F.lit(0)) <= 0, DEFAULT_QUORUMS[severity]).otherwise(value)


def graded(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings under each policy: disabled rules gone, overridden ones regraded. Policies are few by construction
    (a grid, or one or two for each rule), so they are broadcast."""
    both = findings.crossJoin(F.broadcast(rules))
    kept = both.filter(~F.coalesce(F.array_contains("disabled", F.col("rule")), F.lit(False)))
    return kept.withColumn("severity", F.coalesce(F.element_at("overrides", F.col("rule")), F.col("severity")))


def severity_counts(found: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity, the total, and the worst finding: by severity, then stage, rule and order."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    worst = F.struct((-F.coalesce(severity_rank(F.col("severity")), F.lit(-1))).alias("r"), "stage", "rule", "ord", "severity", "description")
    return found.groupBy(*keys).agg(count("critical"), count("high"), count("medium"), F.count("*").alias("signals"), F.min(worst).alias("top"))


def ladder(critical: Column, high: Column, medium: Column, fail_closed: Column | None = None) -> Column:
    """The decision for these counts, given columns of quorums in scope."""
    q = lambda s: quorum(F.col(f"{s}_quorum"), s)
    review = F.lit("quarantine") if fail_closed is None else F.when(F.coalesce(fail_closed, F.lit(False)), "block").otherwise("quarantine")
    return F.when(critical >= q("critical"), "block").when((high >= q("high")) | (medium >= q("medium")), review).otherwise("allow")


def reason(decision: Column) -> Column:
    n = lambda c: F.col(c).cast("string")
    return (
        F.when((decision == "block") & F.col("top").isNotNull(), F.format_string("blocked on %s signal: %s", F.col("top.severity"), F.col("top.description")))
        .when(decision == "block", "blocked")
        .when(decision == "quarantine", F.format_string("quarantined for review: %s high, %s medium signal(s)", n("high"), n("medium")))
        .when(F.col("signals") == 0, "allowed: no signals")
        .otherwise(F.format_string("allowed: %s informational signal(s), none blocking", n("signals")))
    )


def decisions(artifacts: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """policy, digest, decision, reason, and the counts, for every artifact under every policy."""
    counts = severity_counts(graded(findings, rules), "policy", "digest")
    every = artifacts.select("digest").distinct().crossJoin(F.broadcast(rules)).join(counts, ["policy", "digest"], "left").fillna(0, ["critical", "high", "medium", "signals"])
    decision = F.when(F.coalesce("allow_all", F.lit(False)), "allow").otherwise(ladder(F.col("critical"), F.col("high"), F.col("medium"), F.col("fail_closed")))
    return every.withColumn("decision", decision).select("policy", "digest", "decision", reason(F.col("decision")).alias("reason"), "critical", "high", "medium", "signals")


def sorted_signals(findings: DataFrame) -> DataFrame:
    """digest, signals: an artifact's findings as an array, worst first, then by stage, rule and order. An artifact's
    findings are bounded by the rules, the blobs among its files and its trace."""
    entry = F.struct((-F.coalesce(severity_rank(F.col("severity")), F.lit(-1))).alias("r"), "stage", "rule", "ord", "severity", "description", "evidence")
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda s: F.struct(*[s[c].alias(c) for c in ("stage", "rule", "severity", "description", "evidence")]))
    return findings.groupBy("digest").agg(ordered.alias("signals"))


def verdicts(artifacts: DataFrame, findings: DataFrame, rules: DataFrame, engine: str = "static-pipeline", rules_version: str | None = None) -> DataFrame:
    """artifacts (digest, ecosystem, name, version) with policy, decision, reason, signals, decided_at, engine,
    rules_version. Signals are those of the artifact, before any policy."""
    from palisade import __version__

    decided = decisions(artifacts, findings, rules)
    out = artifacts.join(decided, "digest").join(sorted_signals(findings).withColumnRenamed("signals", "found"), "digest", "left")
    return out.select("digest", "ecosystem", "name", "version", "policy", "decision", "reason", "found", F.current_timestamp().alias("decided_at"), F.lit(engine).alias("engine"), F.lit(rules_version or __version__).alias("rules_version")).withColumnRenamed("found", "signals")
