"""The model stage: evidence in, a judgment out, and findings from it.

A model is any object with a name and `judge(evidence) -> judgments`; it never makes the decision. `RuleModel` is a
transparent stand-in in plain columns; `TextModel` wraps a callable on prompts, one call a row, off by default.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.scalars import as_text, clears, last_object, model_judgment, severity_rank
from palisade.operators.decide import decisions
from palisade.sources.scratch import cut

EXCERPTS, EXCERPT_BYTES = 6, 8 << 10
_ORD = 3 * 10**12
_ANSWER = "out string, error string, found string"


def excerpts(files: DataFrame) -> DataFrame:
    """digest, excerpts: path to content of the few files most worth reading, by a fixed priority."""
    rank = F.array_position(F.array(*[F.lit(n) for n in fixed.EXCERPT_NAMES]), F.col("path"))
    found = files.filter(F.col("path").isin(fixed.EXCERPT_NAMES)).groupBy("digest", "path").agg(F.max_by("content", "file_idx").alias("content"))
    order = Window.partitionBy("digest").orderBy("rank")
    top = found.withColumn("rank", rank).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= EXCERPTS)
    entry = F.struct("path", F.substring("content", 1, EXCERPT_BYTES).cast("string").alias("content"))
    return top.groupBy("digest").agg(F.map_from_entries(F.collect_list(entry)).alias("excerpts"))


class Model(ABC):
    name: str

    @abstractmethod
    def judge(self, evidence: DataFrame, findings: DataFrame) -> DataFrame:
        """digest, decision, confidence, rationale, told (array), error (null if it answered).
        evidence: digest, excerpts, behavior_log."""


class RuleModel(Model):
    """Escalates on the worst finding and on markers in the behaviour log."""

    name = "mock"

    def judge(self, evidence: DataFrame, findings: DataFrame) -> DataFrame:
        rank = severity_rank(F.col("severity"))
        bad = F.when(rank >= 3, F.struct("ord", "description"))
        per = findings.groupBy("digest").agg(F.max(rank).alias("worst"), F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(bad)), lambda x: x["description"]).alias("why"))
        marks = F.filter(F.array(*[F.when(F.contains(as_text(F.col("behavior_log")), F.lit(m)), F.lit("behavior log contains " + m)) for m in fixed.MODEL_MARKERS]), lambda x: x.isNotNull())
        both = evidence.withColumn("marks", F.coalesce(marks, F.array().cast("array<string>"))).join(per, "digest", "left")
        worst = F.greatest(F.coalesce("worst", F.lit(0)), F.when(F.size("marks") > 0, 3).otherwise(0))
        word = F.get(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), worst)
        return both.select(
            "digest", F.when(worst == 4, "block").when(worst == 3, "quarantine").otherwise("allow").alias("decision"), F.when(worst == 4, 0.9).when(worst == 3, 0.7).otherwise(0.6).alias("confidence"),
            F.format_string("mock heuristic over %s static signal(s); worst severity %s", F.coalesce("n", F.lit(0)).cast("string"), word).alias("rationale"),
            F.concat(F.coalesce("why", F.array().cast("array<string>")), F.col("marks")).alias("told"), F.lit(None).cast("string").alias("error"),
        )


class TextModel(Model):
    """A callable from prompt to raw output, e.g. a local process; its last JSON object is the judgment. `raw` receives
    a row for each call if it is given."""

    def __init__(self, name: str, call: Callable[[str], str], raw: Callable[[DataFrame], None] | None = None):
        self.name, self.call, self.raw = name, call, raw

    def ask(self, prompts: Column) -> Column:
        """Struct of the output, the failure, and the last JSON object of the output, all from one Python worker."""
        call = self.call

        @F.arrow_udf(_ANSWER)
        def run(texts: pa.Array) -> pa.Array:
            rows = []
            for t in texts:  # one prompt at a time is a Python string
                try:
                    out = call(t.as_py())
                    rows.append({"out": out, "error": None, "found": last_object(out)})
                except Exception as e:  # a model that fails is a finding, not a failure of the job
                    rows.append({"out": None, "error": str(e), "found": None})
            return pa.array(rows, pa.struct([(f, pa.string()) for f in ("out", "error", "found")]))

        return run(prompts)

    def prompt(self, evidence: DataFrame, findings: DataFrame) -> DataFrame:
        told = findings.groupBy("digest").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "rule", "severity", "description", "evidence")))).alias("signals"))
        log = F.coalesce(as_text(F.col("behavior_log")), F.lit("null"))
        diff = F.to_json("diff") if "diff" in evidence.columns else F.lit(None).cast("string")
        return evidence.join(told, "digest", "left").withColumn("prompt", F.concat(F.lit('{"static_signals":'), F.coalesce("signals", F.lit("[]")), F.lit(',"diff":'), F.coalesce(diff, F.lit("null")), F.lit(',"source_excerpts":'), F.coalesce(F.to_json("excerpts"), F.lit("{}")), F.lit(',"behavior_log":'), log, F.lit("}")))

    def judge(self, evidence: DataFrame, findings: DataFrame) -> DataFrame:
        return self.read(self.prompt(evidence, findings).select("digest", "prompt"))

    def read(self, prompts: DataFrame) -> DataFrame:
        asked = prompts.withColumn("r", self.ask(F.col("prompt"))).withColumn("o", model_judgment(F.col("r.found")))
        if self.raw is not None:
            self.raw(asked.select(F.lit(self.name).alias("model"), "digest", "prompt", F.col("r.out").alias("raw_stdout"), F.to_json("o").alias("output"), F.col("r.error").alias("err")))
        error = F.coalesce(F.col("r.error"), F.when(F.col("o").isNull(), F.lit("no valid judgment in the output")))
        return asked.select("digest", F.col("o.verdict").alias("decision"), F.col("o.confidence").alias("confidence"), F.col("o.rationale").alias("rationale"), F.coalesce("o.signals", F.array().cast("array<string>")).alias("told"), error.alias("error"))


class PanelModel(Model):
    """Two reviewers, one of behaviour and one of source, and a combiner. A reviewer that fails is told to the combiner;
    a combiner that fails is the panel's failure."""

    def __init__(self, behavior: TextModel, source: TextModel, combiner: TextModel):
        self.behavior, self.source, self.combiner = behavior, source, combiner
        self.name = "panel/" + combiner.name

    def judge(self, evidence: DataFrame, findings: DataFrame) -> DataFrame:
        blind = evidence.withColumn("excerpts", F.lit(None).cast("map<string,string>"))
        silent = evidence.withColumn("behavior_log", F.lit(None).cast("binary"))
        said = []
        for role, model, seen in (("behavior", self.behavior, blind), ("source", self.source, silent)):
            judged = model.judge(seen, findings)
            text = F.when(F.col("error").isNotNull(), F.concat(F.lit(f"{role} review unavailable: "), F.col("error"))).otherwise(F.concat(F.lit(f"{role} review: "), F.to_json(F.struct("decision", "confidence", "rationale", "told"))))
            said.append(judged.select("digest", text.alias(role)))
        prompts = said[0].join(said[1], "digest").select("digest", F.concat_ws("\n", "behavior", "source").alias("prompt"))
        return self.combiner.read(prompts)


def triage_findings(model: Model, evidence: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings from a model's judgments: its own, its failure, and its disagreement with the rules on clearing.
    rules: one policy. Judgments are written once: findings of three kinds look at them, and no model is asked twice."""
    judged = cut(model.judge(evidence, findings))
    base = ["digest", "stage", "rule", "severity", "description", "evidence", "ord"]
    sound = judged.filter("error IS NULL")
    severity = F.create_map(*[F.lit(x) for kv in fixed.MODEL_SEVERITY.items() for x in kv])
    own = sound.select("digest", F.lit("triage").alias("stage"), F.concat(F.lit("llm-"), F.col("decision")).alias("rule"), severity[F.col("decision")].alias("severity"), F.concat(F.lit(model.name + " triage: "), F.col("rationale")).alias("description"), F.array_join("told", "; ").alias("evidence"), F.lit(_ORD).cast("long").alias("ord"))
    note = lambda key: [F.lit("triage").alias("stage"), *[F.lit(x).alias(c) for x, c in zip(fixed.GATE_RULES[key], ("rule", "severity", "description"), strict=True)]]
    failed = judged.filter("error IS NOT NULL").select("digest", *note("model"), F.col("error").alias("evidence"), F.lit(_ORD).cast("long").alias("ord"))
    decided = decisions(evidence, findings, rules).select("digest", F.col("decision").alias("by_rules"))
    apart = sound.join(decided, "digest").filter(clears(F.col("by_rules")) != clears(F.col("decision")))
    apart = apart.select("digest", *note("disagreement"), F.format_string("rules=%s " + model.name + "=%s", "by_rules", "decision").alias("evidence"), F.lit(_ORD + 1).cast("long").alias("ord"))
    return own.select(base).unionByName(failed.select(base)).unionByName(apart.select(base))
