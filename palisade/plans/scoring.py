"""Façades: findings and verdicts of artifacts, offline and at the gate.

A verdict looks at its findings several times, so they are extracted once into a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.advisories import advisory_findings, unavailable_findings
from palisade.operators.behavior_rules import behavior_findings
from palisade.operators.decide import verdicts
from palisade.operators.static_rules import static_findings
from palisade.operators.triage import Model, excerpts, triage_findings
from palisade.operators.versions import append_history, diff_summary, file_changes, hook_changes, previous_good, setup_changes
from palisade.sources.packages import files_of, unpack_findings
from palisade.sources.scratch import cut


def signals(files: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Behaviour findings, then static ones. Archives that didn't open are silent here."""
    found = static_findings(files)
    return found if traces is None else behavior_findings(traces).unionByName(found)


def score(artifacts: DataFrame, files: DataFrame, traces: DataFrame | None, rules: DataFrame) -> DataFrame:
    """Verdicts from contents and behaviour. Files are written once, as several rules look at them."""
    files = cut(files)
    return verdicts(artifacts, cut(signals(files, traces)), rules, "scorer")


def evidence(artifacts: DataFrame, files: DataFrame, logs: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """digest, excerpts, behavior_log, and diff if there are any, for the model. logs: digest, behavior_log; diffs:
    digest, diff."""
    told = artifacts.select("digest").distinct().join(excerpts(files), "digest", "left").join(logs, "digest", "left")
    return told if diffs is None else told.join(diffs, "digest", "left")


def score_with_model(artifacts: DataFrame, files: DataFrame, traces: DataFrame | None, logs: DataFrame, model: Model, rules: DataFrame) -> DataFrame:
    files = cut(files)
    found = cut(signals(files, traces))
    judged = cut(triage_findings(model, evidence(artifacts, files, logs), found, rules))
    return verdicts(artifacts, found.unionByName(judged), rules, "scorer+triage")


def admit(artifacts: DataFrame, rows: DataFrame, history: DataFrame, rules: DataFrame, advisories: DataFrame | None = None, answered: DataFrame | None = None, previous_files: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """The live gate. rows: unpacked rows of the artifacts; previous_files: files of the versions in history.

    Contents, the difference to the last known-good version, advisories, then the model; archives that didn't open
    count. There is no behaviour at the gate. The difference is told in the verdict and to the model: `diff` is null
    for a first version. `appended` adds the decisions to the history. Archives are unpacked once, into a table.
    """
    rows = cut(rows)
    files = files_of(rows)
    diffs = artifacts.selectExpr("digest", "cast(null as struct<prev_version:string,added:array<string>,removed:array<string>,modified:array<string>>) diff").distinct()
    found = unpack_findings(rows).unionByName(static_findings(files))
    if previous_files is not None:
        pairs = previous_good(artifacts, history, previous_files)
        both = files.unionByName(previous_files.join(files.select("digest").distinct(), "digest", "left_anti"), allowMissingColumns=True)
        pairs = cut(pairs)
        changes = cut(file_changes(pairs, both))
        found = found.unionByName(hook_changes(pairs, both)).unionByName(setup_changes(pairs, both, changes))
        summary = diff_summary(pairs, changes).dropDuplicates(["digest"])
        diffs = cut(artifacts.select("digest").distinct().join(summary.select("digest", F.struct("prev_version", "added", "removed", "modified").alias("diff")), "digest", "left"))
    if advisories is not None:
        found = found.unionByName(advisory_findings(artifacts, advisories))
    if answered is not None:
        found = found.unionByName(unavailable_findings(artifacts, answered))
    engine, found = "static-pipeline", cut(found)
    if model is not None:
        logs = artifacts.selectExpr("digest", "cast(null as binary) behavior_log").distinct()
        found = found.unionByName(cut(triage_findings(model, evidence(artifacts, files, logs, diffs), found, rules)))
        engine = "static+triage-pipeline"
    return verdicts(artifacts, found, rules, engine).join(diffs, "digest", "left")


def appended(history: DataFrame, artifacts: DataFrame, judged: DataFrame) -> DataFrame:
    """History with the gate's decisions on the artifacts (ecosystem, name, version, digest, seq) at its end, so that
    the next version is compared with the last one that was allowed."""
    decided = judged.select("digest", "decision").dropDuplicates(["digest"])
    return append_history(history, artifacts.join(decided, "digest").select(*history.columns))


def package_history(history: DataFrame, ecosystem: str, name: str) -> DataFrame:
    """One package's entries in their order."""
    return history.filter((F.col("ecosystem") == ecosystem) & (F.col("name") == name)).orderBy("seq")
