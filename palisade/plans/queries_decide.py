"""Decision and evaluation queries: users' events stand for artifacts' findings.

An event is a finding of its user: critical, high, medium or low by kind and value; all others are informational.
Users whose id divides by three are the malicious samples, and every fiftieth could not be analysed. Each user has a
quiet twin without findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.decide import Policy, decisions, policies, sorted_signals
from palisade.plans import evaluation

SEVERITY = "CASE WHEN event_type = 'error' AND value > 200 THEN 'critical' WHEN event_type = 'purchase' AND value > 200 THEN 'high' WHEN event_type = 'signup' AND value > 90 THEN 'medium' WHEN value > 60 THEN 'low' ELSE 'info' END"

WITH = f"""
WITH f AS (SELECT CAST(user_id AS VARCHAR) AS digest, event_type AS rule, {SEVERITY} AS severity, event_id AS ord FROM events),
u AS (SELECT DISTINCT q || user_id AS digest, user_id % 3 = 0 AS bad, user_id % 50 = 7 AS broken FROM events, (VALUES (''), ('quiet-')) v(q))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    severity = F.expr(SEVERITY)
    return rows.select(F.col("user_id").cast("string").alias("digest"), F.lit("events").alias("stage"), F.col("event_type").alias("rule"), severity.alias("severity"), F.concat(F.lit("an event of kind "), F.col("event_type")).alias("description"), F.col("event_id").cast("string").alias("evidence"), F.col("event_id").alias("ord"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = events(spark, sf_dir).select("user_id").distinct()
    both = F.explode(F.array(F.col("user_id").cast("string"), F.concat(F.lit("quiet-"), F.col("user_id"))))
    return users.select(both.alias("digest"), F.when(F.col("user_id") % 3 == 0, "malicious").otherwise("benign").alias("label"), F.when(F.col("user_id") % 50 == 7, "no evidence").alias("error"))


def _decide(*given: Policy):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decisions(samples(spark, sf_dir), findings(spark, sf_dir), policies(spark, *given)).drop("reason")

    return query


def _ladder(q: tuple[int, int, int], regrade: str = "severity", where: str = "true", review: str = "quarantine", name: str = "default", source: str = "f") -> str:
    return f"""
        SELECT '{name}' AS policy, u.digest, CASE WHEN critical >= {q[0]} THEN 'block' WHEN high >= {q[1]} OR medium >= {q[2]} THEN '{review}' ELSE 'allow' END AS decision, critical, high, medium, signals
        FROM u LEFT JOIN (SELECT digest, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) AS signals
                          FROM (SELECT digest, {regrade} AS s FROM {source} WHERE {where}) GROUP BY digest) c USING (digest)"""


def _filled(sql: str) -> str:
    return f"SELECT policy, digest, decision, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(signals, 0) AS signals FROM ({sql})"


def _outcome(grid: str) -> str:
    """Tally of a relation d(policy, digest, decision)."""
    return f"""
        SELECT policy, count(*) FILTER (bad) AS malicious, count(*) FILTER (bad AND decision <> 'allow') AS caught, count(*) FILTER (NOT bad) AS benign, count(*) FILTER (NOT bad AND decision <> 'allow') AS flagged,
               count(*) FILTER (NOT bad AND decision = 'block') AS benign_blocked, (SELECT count(*) FROM u WHERE broken) AS errors
        FROM ({grid}) d JOIN u USING (digest) WHERE NOT broken GROUP BY policy"""


def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(samples(spark, sf_dir), findings(spark, sf_dir), policies(spark)).select("digest", "decision", "reason")


def quorum_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.sweep(samples(spark, sf_dir), findings(spark, sf_dir))
    return out.select("critical_quorum", "high_quorum", "medium_quorum", "malicious", "caught", "benign", "flagged", "benign_blocked", "errors", F.round("recall_pct", 6).alias("recall_pct"), F.round("fp_pct", 6).alias("fp_pct"))


def evaluation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.replay(samples(spark, sf_dir), findings(spark, sf_dir), policies(spark, Policy(), Policy("closed", fail_closed=True), Policy("open", allow_all=True)))
    return out.select("policy", "malicious", "caught", "benign", "flagged", "benign_blocked", "errors")


def rule_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attribution(samples(spark, sf_dir), findings(spark, sf_dir))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ablation(samples(spark, sf_dir), findings(spark, sf_dir)).select("rule", "lost_caught", "lost_flagged", F.round("d_recall_pct", 6).alias("d_recall_pct"), F.round("d_fp_pct", 6).alias("d_fp_pct"))


def promotion_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.promotion(samples(spark, sf_dir), findings(spark, sf_dir)).select("rule", "severity", "on_missed", F.round("recall_pct", 6).alias("recall_pct"), F.round("fp_pct", 6).alias("fp_pct"), "benign_blocked")


def miss_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.miss_analysis(samples(spark, sf_dir), findings(spark, sf_dir))


def miss_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.miss_rules(samples(spark, sf_dir), findings(spark, sf_dir))


def signal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each artifact in the order of its verdict, as one string."""
    rows = sorted_signals(findings(spark, sf_dir))
    return rows.select("digest", F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["severity"], s["rule"], s["evidence"])), ",").alias("signals"))


_GRID = " UNION ALL ".join(_ladder((c, h, m), name=f"{c},{h},{m}") for c in (1, 2) for h in (1, 2, 3) for m in (1, 2, 3, 4))
_PCT = "round(CASE WHEN malicious = 0 THEN 0 ELSE caught * 100.0 / malicious END, 6) AS recall_pct, round(CASE WHEN benign = 0 THEN 0 ELSE flagged * 100.0 / benign END, 6) AS fp_pct"
_RULES = ["error", "purchase", "signup", "click", "view"]
_BASE = f"base AS ({_outcome(_ladder((1, 1, 2)))})"
_OFF = " UNION ALL ".join(_ladder((1, 1, 2), where=f"rule <> '{r}'", name=r) for r in _RULES)
_UP = " UNION ALL ".join(_ladder((1, 1, 2), regrade=f"CASE WHEN rule = '{r}' THEN '{s}' ELSE severity END", name=f"{r}/{s}") for r in _RULES for s in ("medium", "high"))
_MISSED = f"missed AS (SELECT digest FROM ({_ladder((1, 1, 2))}) d JOIN u USING (digest) WHERE bad AND NOT broken AND decision = 'allow')"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

QUERIES = {
    "decision_ladder": _decide(Policy()),
    "fail_closed": _decide(Policy("closed", fail_closed=True)),
    "rule_disable": _decide(Policy("no-error", disabled=("error",))),
    "severity_override": _decide(Policy("view-high", overrides={"view": "high"})),
    "decision_reasons": decision_reasons,
    "quorum_sweep": quorum_sweep,
    "evaluation_tally": evaluation_tally,
    "rule_attribution": rule_attribution,
    "rule_ablation": rule_ablation,
    "promotion_pricing": promotion_pricing,
    "miss_analysis": miss_analysis,
    "miss_rules": miss_rules,
    "signal_order": signal_order,
}

SQL = {
    "decision_ladder": f"{WITH} {_filled(_ladder((1, 1, 2)))}",
    "fail_closed": f"{WITH} {_filled(_ladder((1, 1, 2), review='block', name='closed'))}",
    "rule_disable": WITH + " " + _filled(_ladder((1, 1, 2), where="rule <> 'error'", name="no-error")),
    "severity_override": WITH + " " + _filled(_ladder((1, 1, 2), regrade="CASE WHEN rule = 'view' THEN 'high' ELSE severity END", name="view-high")),
    "decision_reasons": f"""{WITH}, top AS (SELECT digest, min_by(struct_pack(s := severity, r := rule), struct_pack(a := -({_RANK}), b := rule, c := ord)) AS t FROM f GROUP BY digest)
        SELECT d.digest, decision, CASE decision WHEN 'block' THEN 'blocked on ' || t.s || ' signal: an event of kind ' || t.r
            WHEN 'quarantine' THEN 'quarantined for review: ' || high || ' high, ' || medium || ' medium signal(s)'
            ELSE CASE WHEN signals = 0 THEN 'allowed: no signals' ELSE 'allowed: ' || signals || ' informational signal(s), none blocking' END END AS reason
        FROM ({_filled(_ladder((1, 1, 2)))}) d LEFT JOIN top USING (digest)""",
    "quorum_sweep": f"""{WITH} SELECT CAST(split_part(policy, ',', 1) AS INTEGER) AS critical_quorum, CAST(split_part(policy, ',', 2) AS INTEGER) AS high_quorum, CAST(split_part(policy, ',', 3) AS INTEGER) AS medium_quorum,
        malicious, caught, benign, flagged, benign_blocked, errors, {_PCT} FROM ({_outcome(_GRID)})""",
    "evaluation_tally": WITH + " " + _outcome(_ladder((1, 1, 2)) + " UNION ALL " + _ladder((1, 1, 2), review="block", name="closed") + " UNION ALL SELECT 'open', digest, 'allow', 0, 0, 0, 0 FROM u"),
    "rule_attribution": f"{WITH} SELECT rule, count(DISTINCT digest) FILTER (bad) AS malicious, count(DISTINCT digest) FILTER (NOT bad) AS benign FROM f JOIN u USING (digest) GROUP BY rule",
    "rule_ablation": f"""{WITH}, {_BASE}, o AS ({_outcome(_OFF)})
        SELECT o.policy AS rule, base.caught - o.caught AS lost_caught, base.flagged - o.flagged AS lost_flagged,
               round((base.caught - o.caught) * 100.0 / base.malicious, 6) AS d_recall_pct, round((base.flagged - o.flagged) * 100.0 / base.benign, 6) AS d_fp_pct
        FROM o, base WHERE o.policy IN (SELECT rule FROM f)""",
    "promotion_pricing": f"""{WITH}, {_MISSED}, seen AS (SELECT rule, count(*) AS on_missed FROM f WHERE digest IN (SELECT digest FROM missed) AND severity NOT IN ('high', 'critical') GROUP BY rule), o AS ({_outcome(_UP)})
        SELECT rule, split_part(policy, '/', 2) AS severity, on_missed, {_PCT}, benign_blocked FROM o JOIN seen ON rule = split_part(policy, '/', 1)""",
    "miss_analysis": f"{WITH}, {_MISSED} SELECT CASE WHEN digest IN (SELECT digest FROM f) THEN 'sub-threshold' ELSE 'silent' END AS kind, count(*) AS n FROM missed GROUP BY 1",
    "miss_rules": f"{WITH}, {_MISSED} SELECT rule, count(DISTINCT digest) AS n FROM f WHERE digest IN (SELECT digest FROM missed) GROUP BY rule ORDER BY n DESC, rule LIMIT 8",
    "signal_order": f"{WITH} SELECT digest, string_agg(severity || ':' || rule || ':' || ord, ',' ORDER BY {_RANK} DESC, rule, ord) AS signals FROM f GROUP BY digest",
}
