"""Evaluation: findings are extracted once, policies are replayed over them many times.

samples: digest, label ('malicious' or anything else for benign), error (null if it was analysed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.decide import Policy, decisions, ladder, policies, quorum_grid, severity_counts


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole)


def tally(samples: DataFrame, decided: DataFrame) -> DataFrame:
    """A row a policy: malicious, caught, recall_pct, benign, flagged, fp_pct, benign_blocked, errors."""
    sound = samples.filter("error IS NULL").select("digest", (F.col("label") == "malicious").alias("bad"))
    rows = decided.join(sound, "digest").withColumn("hit", F.col("decision") != "allow")
    out = rows.groupBy("policy").agg(
        F.count_if("bad").alias("malicious"), F.count_if(F.col("bad") & F.col("hit")).alias("caught"), F.count_if(~F.col("bad")).alias("benign"),
        F.count_if(~F.col("bad") & F.col("hit")).alias("flagged"), F.count_if(~F.col("bad") & (F.col("decision") == "block")).alias("benign_blocked"),
    )
    errors = samples.agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    return out.crossJoin(F.broadcast(errors)).withColumn("recall_pct", percent(F.col("caught"), F.col("malicious"))).withColumn("fp_pct", percent(F.col("flagged"), F.col("benign")))


def _every(samples: DataFrame, rules: DataFrame, told: DataFrame) -> DataFrame:
    """The tally of every policy; zeros where no sample could be analysed."""
    errors = samples.agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    return rules.select("policy").join(told.drop("errors"), "policy", "left").fillna(0).crossJoin(F.broadcast(errors))


def replay(samples: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The tally of each policy."""
    return _every(samples, rules, tally(samples, decisions(samples.filter("error IS NULL"), findings, rules)))


def sweep(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """The quorum grid: severities are counted once an artifact, then every policy looks at the same counts."""
    grid = quorum_grid(samples.sparkSession)
    counts = severity_counts(findings, "digest").select("digest", "critical", "high", "medium")
    sound = samples.filter("error IS NULL")
    every = sound.select("digest").join(counts, "digest", "left").fillna(0, ["critical", "high", "medium"]).crossJoin(F.broadcast(grid))
    decided = every.select("policy", "digest", ladder(F.col("critical"), F.col("high"), F.col("medium")).alias("decision"))
    return _every(samples, grid, tally(samples, decided)).join(F.broadcast(grid.select("policy", "critical_quorum", "high_quorum", "medium_quorum")), "policy")


def attribution(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """rule, malicious, benign: samples that it fires on, by label."""
    bad = samples.select("digest", (F.col("label") == "malicious").alias("bad"))
    fired = findings.select("digest", "rule").distinct().join(bad, "digest")
    return fired.groupBy("rule").agg(F.count_if("bad").alias("malicious"), F.count_if(~F.col("bad")).alias("benign"))


def _rule_policies(names: DataFrame, kinds: DataFrame) -> DataFrame:
    """A policy for each rule and kind (tag, severity): without a severity the rule is disabled."""
    both = names.crossJoin(F.broadcast(kinds))
    none = F.col("severity").isNull()
    zero = [F.lit(0).alias(c) for c in ("critical_quorum", "high_quorum", "medium_quorum")]
    return both.select(
        F.concat_ws(" -> ", "rule", "tag").alias("policy"), *zero, F.lit(False).alias("fail_closed"), F.when(none, F.array("rule")).otherwise(F.array().cast("array<string>")).alias("disabled"),
        F.when(none, F.create_map().cast("map<string,string>")).otherwise(F.create_map("rule", "severity")).alias("overrides"), F.lit(False).alias("allow_all"), "rule", "tag",
    )


def _changed(samples: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The default tally with the change that each single-rule policy makes. Only artifacts that the rule fires on can
    decide otherwise, so a policy is replayed over these alone: rules x their own artifacts, not rules x all."""
    spark = samples.sparkSession
    sound = samples.filter("error IS NULL").select("digest", (F.col("label") == "malicious").alias("bad"))
    base = decisions(sound, findings, policies(spark, Policy())).select("digest", F.col("decision").alias("was"))
    touched = findings.select("digest", "rule").distinct().join(F.broadcast(rules.select("rule", "policy", "disabled", "overrides")), "rule").withColumnRenamed("rule", "of")
    found = touched.join(findings, "digest")
    kept = found.filter(~F.array_contains("disabled", F.col("rule"))).withColumn("severity", F.coalesce(F.element_at("overrides", F.col("rule")), F.col("severity")))
    counts = severity_counts(kept, "policy", "digest").select("policy", "digest", "critical", "high", "medium")
    zero = [F.lit(0).alias(c) for c in ("critical_quorum", "high_quorum", "medium_quorum")]
    now = touched.select("policy", "digest").join(counts, ["policy", "digest"], "left").fillna(0, ["critical", "high", "medium"]).select("*", *zero)
    now = now.withColumn("now", ladder(F.col("critical"), F.col("high"), F.col("medium"))).select("policy", "digest", "now")
    both = now.join(base, "digest").join(sound, "digest")
    hit = lambda c: (F.col(c) != "allow").cast("long")
    block = lambda c: (F.col(c) == "block").cast("long")
    step = lambda who, f: F.sum(F.when(who, f("now") - f("was")).otherwise(0))
    delta = both.groupBy("policy").agg(step(F.col("bad"), hit).alias("d_caught"), step(~F.col("bad"), hit).alias("d_flagged"), step(~F.col("bad"), block).alias("d_blocked"))
    total = replay(samples, findings, policies(spark, Policy())).drop("policy")
    return rules.select("policy", "rule", "tag").join(delta, "policy", "left").fillna(0).crossJoin(F.broadcast(total))


def ablation(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """rule, d_recall_pct, lost_caught, d_fp_pct, lost_flagged: what goes when the rule goes."""
    kinds = samples.sparkSession.createDataFrame([("off", None)], "tag string, severity string")
    x = _changed(samples, findings, _rule_policies(findings.select("rule").distinct(), kinds))
    return x.select("rule", percent(-F.col("d_caught"), F.col("malicious")).alias("d_recall_pct"), (-F.col("d_caught")).alias("lost_caught"), percent(-F.col("d_flagged"), F.col("benign")).alias("d_fp_pct"), (-F.col("d_flagged")).alias("lost_flagged"))


def promotion(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """rule, severity, on_missed, recall_pct, fp_pct, benign_blocked: what regrading each rule seen on missed malware
    to medium or high would buy and cost. on_missed counts findings."""
    spark = samples.sparkSession
    missed = _missed(samples, findings)
    seen = findings.filter(~F.col("severity").isin("high", "critical")).join(missed, "digest", "left_semi").groupBy("rule").agg(F.count("*").alias("on_missed"))
    kinds = spark.createDataFrame([("medium", "medium"), ("high", "high")], "tag string, severity string")
    x = _changed(samples, findings, _rule_policies(seen.select("rule"), kinds)).join(seen, "rule")
    return x.select("rule", F.col("tag").alias("severity"), "on_missed", percent(F.col("caught") + F.col("d_caught"), F.col("malicious")).alias("recall_pct"), percent(F.col("flagged") + F.col("d_flagged"), F.col("benign")).alias("fp_pct"), (F.col("benign_blocked") + F.col("d_blocked")).alias("benign_blocked"))


def _missed(samples: DataFrame, findings: DataFrame) -> DataFrame:
    bad = samples.filter("error IS NULL AND label = 'malicious'")
    return decisions(bad, findings, policies(samples.sparkSession, Policy())).filter("decision = 'allow'").select("digest")


def miss_analysis(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """kind, n: missed malware without any finding ('silent') and with findings below the bar ('sub-threshold')."""
    counts = _missed(samples, findings).join(findings.groupBy("digest").agg(F.count("*").alias("n")), "digest", "left")
    return counts.groupBy(F.when(F.col("n").isNull(), "silent").otherwise("sub-threshold").alias("kind")).agg(F.count("*").alias("n"))


def miss_rules(samples: DataFrame, findings: DataFrame, top: int = 8) -> DataFrame:
    """rule, n: the rules seen most on missed malware, once a sample; ties by name."""
    return findings.select("digest", "rule").distinct().join(_missed(samples, findings), "digest", "left_semi").groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(top)


def decision_counts(results: DataFrame) -> DataFrame:
    """decision, n, and the share of runs that left no trace in percent, for detonation results."""
    total = results.agg(F.count("*").alias("runs"), F.count_if(F.col("decision") == "NO_TRACE").alias("lost"))
    return results.groupBy("decision").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("decision", "n", percent(F.col("lost"), F.col("runs")).alias("trace_loss_pct"))


def flagged_histogram(results: DataFrame, top: int = 20) -> DataFrame:
    """decision, rules, n: the commonest outcomes that aren't allow."""
    return results.filter("decision <> 'allow'").groupBy("decision", "rules").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "decision", "rules").limit(top)
