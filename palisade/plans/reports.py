"""The evaluator's views, in the order in which they are read, as tables, text or JSON."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.decide import Policy, policies
from palisade.plans import evaluation

MODES = ("report", "sweep", "ablate", "promote", "all")
#: Fields of the JSON report. Fixed values.
FIELDS = ("malicious", "caught", "recall_pct", "benign", "flagged", "fp_pct", "benign_blocked", "errors")


def views(samples: DataFrame, findings: DataFrame, mode: str = "report", policy: Policy | None = None) -> dict[str, DataFrame]:
    """Tables by title. Each has a row a policy, rule or kind and is ordered in full; ties go by name."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    wanted = {"report", "sweep", "ablate", "promote"} if mode == "all" else {mode}
    out = {}
    if "report" in wanted:
        rules = policies(samples.sparkSession, policy or Policy())
        out["report"] = evaluation.replay(samples, findings, rules).select(*FIELDS)
        out["rules"] = evaluation.attribution(samples, findings).orderBy(F.desc("malicious"), "rule")
        out["misses"] = evaluation.miss_analysis(samples, findings).orderBy("kind")
        out["rules on misses"] = evaluation.miss_rules(samples, findings)
    if "sweep" in wanted:
        grid = evaluation.sweep(samples, findings).orderBy("critical_quorum", "high_quorum", "medium_quorum")
        out["sweep"] = grid.select("critical_quorum", "high_quorum", "medium_quorum", "recall_pct", "fp_pct", "benign_blocked")
    if "ablate" in wanted:
        out["ablation"] = evaluation.ablation(samples, findings).orderBy(F.desc("d_recall_pct"), "rule")
    if "promote" in wanted:
        # medium before high
        out["promotion"] = evaluation.promotion(samples, findings).orderBy(F.desc("on_missed"), "rule", F.desc("severity"))
    return out


def report_json(samples: DataFrame, findings: DataFrame, policy: Policy | None = None) -> DataFrame:
    """One row, document: the report as JSON."""
    return views(samples, findings, "report", policy)["report"].select(F.to_json(F.struct(*FIELDS)).alias("document"))


def text(tables: dict[str, DataFrame]) -> Iterator[str]:
    """The views as lines, one partition at a time; percentages have two digits."""
    for title, table in tables.items():
        yield f"== {title} =="
        yield "\t".join(table.columns)
        for row in table.toLocalIterator():
            yield "\t".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in row)
        yield ""
