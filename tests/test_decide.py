"""Decisions, evaluation, versions, advisories and triage."""

import json
import uuid

import pytest
from palisade.operators.advisories import advisory_findings, unavailable_findings
from palisade.operators.decide import Policy, decisions, policies, quorum_grid, sorted_signals
from palisade.operators.triage import PanelModel, RuleModel, TextModel, excerpts, triage_findings
from palisade.operators.versions import append_history, diff_findings, diff_summary, file_changes, previous_good
from palisade.plans import evaluation, registry
from palisade.plans.scoring import admit, appended, package_history
from palisade.sources.sinks import opened, sealed
from palisade.sources.tables import listed, trace_errors, unlisted

FINDING = "digest string, stage string, rule string, severity string, description string, evidence string, ord long"


def findings(spark, rows):
    return spark.createDataFrame([(d, "static", r, s, f"about {r}", None, i) for i, (d, r, s) in enumerate(rows)], FINDING)


@pytest.mark.parametrize(
    ("severities", "fail_closed", "decision", "reason"),
    [
        ([], False, "allow", "allowed: no signals"), (["low"], False, "allow", "allowed: 1 informational signal(s), none blocking"), (["medium"], False, "allow", None), (["medium", "medium"], False, "quarantine", "quarantined for review: 0 high, 2 medium signal(s)"),
        (["high"], False, "quarantine", None), (["critical"], False, "block", "blocked on critical signal: about r0"), (["low", "critical"], False, "block", "blocked on critical signal: about r1"), (["high"], True, "block", "blocked on high signal: about r0"),
    ],
)
def test_ladder(spark, severities, fail_closed, decision, reason):
    found = findings(spark, [("a", f"r{i}", s) for i, s in enumerate(severities)])
    row = decisions(spark.createDataFrame([("a",)], "digest string"), found, policies(spark, Policy(fail_closed=fail_closed))).first()
    assert row.decision == decision and (reason is None or row.reason == reason)


def test_policies(spark):
    found = findings(spark, [("a", "x", "critical"), ("a", "y", "low"), ("b", "y", "low")])
    given = policies(spark, Policy("off", disabled=("x",)), Policy("up", overrides={"y": "high"}), Policy("two", critical_quorum=2), Policy("negative", critical_quorum=-1), Policy("open", allow_all=True))
    got = {(r.policy, r.digest): r.decision for r in decisions(found.select("digest"), found, given).collect()}
    assert got == {("off", "a"): "allow", ("off", "b"): "allow", ("up", "a"): "block", ("up", "b"): "quarantine", ("two", "a"): "allow", ("two", "b"): "allow", ("negative", "a"): "block", ("negative", "b"): "allow", ("open", "a"): "allow", ("open", "b"): "allow"}
    assert quorum_grid(spark).count() == 24


def test_signal_order(spark):
    rows = [("a", "z", "low"), ("a", "y", "critical"), ("a", "b", "high"), ("a", "a", "high"), ("a", "a", "high")]
    got = sorted_signals(findings(spark, rows).repartition(4)).first().signals
    assert [(s.severity, s.rule) for s in got] == [("critical", "y"), ("high", "a"), ("high", "a"), ("high", "b"), ("low", "z")]


def test_evaluation(spark):
    samples = spark.createDataFrame([("m1", "malicious", None), ("m2", "malicious", None), ("m3", "malicious", None), ("b1", "benign", None), ("b2", "other", None), ("e", "malicious", "no evidence")], "digest string, label string, error string")
    found = findings(spark, [("m1", "x", "critical"), ("m2", "y", "medium"), ("m2", "y", "medium"), ("b1", "x", "critical"), ("b2", "z", "low"), ("m3", "z", "low"), ("m3", "z", "low")])
    t = evaluation.replay(samples, found, policies(spark)).first()
    assert (t.malicious, t.caught, t.benign, t.flagged, t.benign_blocked, t.errors) == (3, 2, 2, 1, 1, 1)
    assert round(t.recall_pct, 3) == 66.667 and t.fp_pct == 50
    off = {r.rule: (r.lost_caught, r.lost_flagged) for r in evaluation.ablation(samples, found).collect()}
    assert off == {"x": (1, 1), "y": (1, 0), "z": (0, 0)}
    up = {(r.rule, r.severity): (r.on_missed, round(r.recall_pct), r.benign_blocked) for r in evaluation.promotion(samples, found).collect()}
    assert up == {("z", "medium"): (2, 100, 1), ("z", "high"): (2, 100, 1)}
    assert {r.kind: r.n for r in evaluation.miss_analysis(samples, found).collect()} == {"sub-threshold": 1}
    assert [(r.rule, r.n) for r in evaluation.miss_rules(samples, found).collect()] == [("z", 1)]
    results = spark.createDataFrame([("a", "block", "x"), ("b", "NO_TRACE", ""), ("c", "allow", ""), ("d", "block", "x")], "name string, decision string, rules string")
    assert {r.decision: (r.n, r.trace_loss_pct) for r in evaluation.decision_counts(results).collect()}["block"] == (2, 25.0)
    assert evaluation.flagged_histogram(results).first().n == 2


def files(spark, rows):
    return spark.createDataFrame([(d, e, i, p, c.encode()) for d, e, i, p, c in rows], "digest string, ecosystem string, file_idx int, path string, content binary")


def test_versions(spark):
    pkg = lambda **s: json.dumps({"scripts": s})
    rows = [("v1", "npm", 0, "package.json", pkg(install="a")), ("v1", "npm", 1, "x.js", "1"), ("v1", "npm", 2, "old.js", "1"), ("v2", "npm", 0, "package.json", pkg(install="b", postinstall="c")), ("v2", "npm", 1, "x.js", "2"), ("v2", "npm", 2, "new.js", "1"), ("p1", "pypi", 0, "a.py", "1"), ("p2", "pypi", 0, "setup.py", "1"), ("p3", "pypi", 0, "setup.py", "2")]
    pairs = spark.createDataFrame([("v2", "1.0", "v1"), ("p2", "1", "p1"), ("p3", "2", "p2")], "digest string, prev_version string, prev_digest string")
    fs = files(spark, rows)
    assert sorted((r.digest, r.rule, r.severity, r.evidence) for r in diff_findings(pairs, fs).collect()) == [("p2", "py-setup-added", "medium", "setup.py"), ("p3", "py-setup-changed", "low", "setup.py"), ("v2", "npm-install-hook-added", "high", "c"), ("v2", "npm-install-hook-changed", "medium", "b")]
    s = {r.digest: r for r in diff_summary(pairs, file_changes(pairs, fs)).collect()}["v2"]
    assert (s.prev_version, s.added, s.removed, s.modified) == ("1.0", ["new.js"], ["old.js"], ["package.json", "x.js"])


def test_previous_good(spark):
    h = [("1", "d1", "allow", 1), ("2", "d2", "block", 2), ("3", "d3", "allow", 3), ("4", "d3", "allow", 4), ("5", "d4", "allow", 9)]
    history = spark.createDataFrame([("npm", "x", *r) for r in h], "ecosystem string, name string, version string, digest string, decision string, seq long")
    ask = lambda d, s: spark.createDataFrame([("npm", "x", d, s)], "ecosystem string, name string, digest string, seq long")
    assert previous_good(ask("new", 5), history).first().prev_version == "4"
    assert previous_good(ask("d3", 5), history).first().prev_version == "1"
    assert previous_good(ask("new", 1), history).count() == 0
    readable = spark.createDataFrame([("d1",)], "digest string")
    assert previous_good(ask("new", 5), history, readable).first().prev_version == "1"
    more = spark.createDataFrame([("npm", "x", "6", "d1", "block", 10), ("npm", "x", "7", "d9", "allow", 11)], history.schema)
    assert {(r.digest, r.seq) for r in append_history(history, more).collect()} == {("d1", 1), ("d2", 2), ("d3", 3), ("d4", 9), ("d9", 11)}


def test_advisories(spark):
    arts = spark.createDataFrame([("a", "pypi", "x", "1"), ("b", "npm", "x", "1")], "digest string, ecosystem string, name string, version string")
    adv = spark.createDataFrame([("PyPI", "x", "1", "V-1", "bad", "critical", None), ("PyPI", "x", "1", "V-2", "", None, [("CVSS_V3", "v")]), ("PyPI", "x", "1", "V-3", None, "odd", []), ("PyPI", "x", "2", "V-4", "", "LOW", None)], "ecosystem string, name string, version string, id string, summary string, db_severity string, severity array<struct<type:string,score:string>>")
    got = {(r.digest, r.rule): (r.severity, r.description) for r in advisory_findings(arts, adv).collect()}
    assert got == {("a", "V-1"): ("critical", "known vulnerability V-1: bad"), ("a", "V-2"): ("high", "known vulnerability V-2"), ("a", "V-3"): ("medium", "known vulnerability V-3")}
    answered = spark.createDataFrame([("a", None), ("b", "timeout")], "digest string, error string")
    assert [(r.digest, r.rule, r.severity) for r in unavailable_findings(arts, answered).collect()] == [("b", "osv-unavailable", "info")]


def test_triage(spark):
    found = findings(spark, [("crit", "x", "critical"), ("high", "x", "high"), ("low", "x", "low")])
    evidence = spark.createDataFrame([("crit", None, None), ("high", None, None), ("low", None, None), ("log", None, b"opens /etc/shadow to exfil"), ("none", None, b"")], "digest string, excerpts map<string,string>, behavior_log binary")
    got = {r.digest: r for r in RuleModel().judge(evidence, found).collect()}
    assert {d: (r.decision, r.confidence) for d, r in got.items()} == {"crit": ("block", 0.9), "high": ("quarantine", 0.7), "low": ("allow", 0.6), "log": ("quarantine", 0.7), "none": ("allow", 0.6)}
    assert got["log"].told == ["behavior log contains /etc/shadow", "behavior log contains exfil"] and got["crit"].rationale == "mock heuristic over 1 static signal(s); worst severity critical"
    out = triage_findings(RuleModel(), evidence, found, policies(spark)).collect()
    assert {(r.digest, r.rule, r.severity) for r in out} == {("crit", "llm-block", "high"), ("high", "llm-quarantine", "medium"), ("low", "llm-allow", "info"), ("log", "llm-quarantine", "medium"), ("log", "rules-llm-disagreement", "medium"), ("none", "llm-allow", "info")}


def test_text_models(spark):
    def answer(prompt):
        if "fail" in prompt:
            raise RuntimeError("model down")
        return 'so: {"verdict": "block", "confidence": 1, "rationale": "r", "signals": ["a", "b"]}'

    found = findings(spark, [("a", "x", "low")])
    evidence = spark.createDataFrame([("a", {"setup.py": "x"}, None), ("b", {"setup.py": "fail"}, None)], "digest string, excerpts map<string,string>, behavior_log binary")
    raw = []
    out = triage_findings(TextModel("m", answer, raw.append), evidence, found, policies(spark)).collect()
    assert {(r.digest, r.rule, r.evidence) for r in out} == {("a", "llm-block", "a; b"), ("a", "rules-llm-disagreement", "rules=allow m=block"), ("b", "triage-unavailable", "model down")}
    assert {r.digest: r.err for r in raw[0].collect()} == {"a": None, "b": "model down"}

    def combine(prompt):
        assert "behavior review" in prompt and "source review" in prompt
        return '{"verdict": "%s", "confidence": 0.5, "rationale": "", "signals": []}' % ("quarantine" if "unavailable" in prompt else "allow")

    panel = PanelModel(TextModel("b", answer), TextModel("s", answer), TextModel("c", combine))
    assert {r.digest: r.decision for r in panel.judge(evidence, found).collect()} == {"a": "allow", "b": "quarantine"}


def test_a_model_is_asked_once(spark, tmp_path):
    """One call a prompt, whichever of the three kinds of findings its judgment gives; the output is read where it was made."""
    def answer(prompt):
        (tmp_path / uuid.uuid4().hex).write_text(prompt)
        if "fail" in prompt:
            raise RuntimeError("model down")
        return "none" if "mute" in prompt else '{} then {"verdict": "block", "confidence": 1, "rationale": "r", "signals": []} done'

    evidence = spark.createDataFrame([(d, {"setup.py": d}, None) for d in ("a", "b", "fail", "mute")], "digest string, excerpts map<string,string>, behavior_log binary")
    found, model = findings(spark, [("a", "x", "low")]), TextModel("m", answer)
    out = triage_findings(model, evidence, found, policies(spark)).collect()
    assert {(r.digest, r.rule, r.evidence) for r in out} == {(d, "llm-block", "") for d in "ab"} | {(d, "rules-llm-disagreement", "rules=allow m=block") for d in "ab"} | {("fail", "triage-unavailable", "model down"), ("mute", "triage-unavailable", "no valid judgment in the output")}
    assert len(list(tmp_path.iterdir())) == 4
    plan = model.read(evidence.selectExpr("digest", "digest AS prompt"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_excerpts(spark):
    rows = [("a", "npm", i, p, "x" * 9000) for i, p in enumerate(["__init__.py", "main.js", "index.js", "pyproject.toml", "setup.cfg", "setup.py", "package.json", "other.js"])]
    got = excerpts(files(spark, rows)).first().excerpts
    assert set(got) == {"package.json", "setup.py", "setup.cfg", "pyproject.toml", "index.js", "main.js"} and all(len(v) == 8192 for v in got.values())


def test_every_branch_occurs(spark):
    """The registered queries reach all decisions."""
    d = "/root/testdata/sf0.01"
    for name in ("decision_ladder", "package_verdicts", "behavior_verdicts"):
        assert {r.decision for r in registry.queries()[name](spark, d).select("decision").distinct().collect()} >= {"quarantine", "block"}, name
    assert {r.decision for r in registry.queries()["decision_ladder"](spark, d).select("decision").distinct().collect()} == {"allow", "quarantine", "block"}
    seen = {r.rule for r in registry.queries()["behavior_findings"](spark, d).select("rule").distinct().collect()}
    assert {"data-destruction", "recon-burst", "dns-exfil", "exfil-chain", "download-and-execute"} <= seen, seen
    rules = {r.rule for r in registry.queries()["package_findings"](spark, d).select("rule").distinct().collect()}
    assert len(rules) >= 16, rules


def test_gate_compares_with_the_last_good_version(spark):
    """Two versions through the gate: the second is told apart from the first, in the verdict and to the model."""
    row = "digest string, ecosystem string, file_idx int, path string, content binary, size long, truncated boolean, unpack_error string"
    pkg = lambda **s: json.dumps({"scripts": s}).encode()
    v1 = [("d1", "npm", 0, "package.json", pkg(test="x"), 1, False, None), ("d1", "npm", 1, "a.js", b"1", 1, False, None)]
    v2 = [("d2", "npm", 0, "package.json", pkg(postinstall="node a.js"), 1, False, None), ("d2", "npm", 1, "b.js", b"1", 1, False, None)]
    art = lambda d, v, seq: spark.createDataFrame([("npm", "x", v, d, seq)], "ecosystem string, name string, version string, digest string, seq long")
    none = spark.createDataFrame([], "ecosystem string, name string, version string, digest string, decision string, seq long")
    rows1, rows2 = spark.createDataFrame(v1, row), spark.createDataFrame(v2, row)
    first = admit(art("d1", "1.0", 1), rows1, none, policies(spark), previous_files=rows1.limit(0).drop("unpack_error"))
    assert (first.first().decision, first.first()["diff"]) == ("allow", None)
    history = appended(none, art("d1", "1.0", 1), first)
    assert [(r.version, r.decision) for r in package_history(history, "npm", "x").collect()] == [("1.0", "allow")]
    model = TextModel("m", lambda prompt: '{"verdict": "allow", "confidence": 1, "rationale": "' + ("told" if '"diff":{"prev_version":"1.0"' in prompt else "not told") + '", "signals": []}')
    second = admit(art("d2", "1.1", 2), rows2, history, policies(spark), previous_files=rows1.drop("unpack_error"), model=model).first()
    d = second["diff"]
    assert (d.prev_version, d.added, d.removed, d.modified) == ("1.0", ["b.js"], ["a.js"], ["package.json"])
    assert {"npm-install-hook-added", "llm-allow"} <= {s.rule for s in second.signals} and second.decision != "allow"
    assert any(s.description == "m triage: told" for s in second.signals)
    kept = opened(sealed(spark.createDataFrame([second], admit(art("d2", "1.1", 2), rows2, none, policies(spark)).schema))).first()
    assert kept["diff"].added == ["b.js"]


def test_lookup_notes_and_evidence(spark):
    given = spark.createDataFrame([("a", "npm", "x", "1"), ("b", "cargo", "x", "1")], "digest string, ecosystem string, name string, version string")
    known = spark.createDataFrame([("npm", "x", "1", "GHSA-1", "bad", "HIGH", None)], "ecosystem string, name string, version string, id string, summary string, db_severity string, severity array<struct<type:string,score:string>>")
    got = sorted((r.digest, r.rule, r.severity, r.evidence) for r in advisory_findings(given, known).collect())
    assert got == [("a", "GHSA-1", "high", "GHSA-1"), ("b", "osv-unavailable", "info", 'osv: unsupported ecosystem "cargo"')]
    raw = spark.createDataFrame([("a", "npm", '{"Analysis": {}}'), ("b", "npm", "{"), ("c", "npm", '{"x": 1}')], "digest string, ecosystem string, json string")
    assert {r.digest: r.error for r in trace_errors(raw).collect()} == {"b": "behavior: parse trace", "c": "behavior: trace has no Analysis section"}
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    assert [r.digest for r in listed(raw, names, "digest").collect()] == ["a"] and sorted(r.digest for r in unlisted(raw, names, "digest").collect()) == ["b", "c"]
