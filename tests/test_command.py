"""Command lines, the evaluator's views, and the sandbox's folders."""

import gzip
import io
import json
import zipfile

import pytest
from test_sources import tgz

from palisade import command
from palisade.plans import reports
from palisade.sources import sandbox, tables

EVIL = [("package/package.json", b"{}"), ("package/i.js", b"eval(atob('x'))")]
TRACE = json.dumps({"Analysis": {"install": {"Status": "completed", "Files": [], "Sockets": [], "Commands": [], "DNS": []}}})


def samples_of(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.tgz").write_bytes(tgz(EVIL))
    (root / "b.tgz").write_bytes(tgz([("package/package.json", b"{}"), ("package/i.js", b"1")]))
    (root / "t.json").write_text(TRACE)
    lines = ["# note", f"npm\ta\tmalicious\t{root}/a.tgz\t-", "npm\ta\tmalicious\ta.tgz", "npm\tb\tbenign\tb.tgz\tt.json", "npm\tc\tmalicious\tb.tgz", "npm\td\tbenign\tno.tgz", "npm\te\tbenign"]
    (tmp_path / "m.tsv").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "m.tsv"), str(root)


def test_evaluate(spark, tmp_path, capsys):
    manifest, root = samples_of(tmp_path)
    samples, findings = command.evidence(spark, manifest, root + "/")
    assert sorted((r.name, r.error) for r in samples.collect() if r.error) == [("d", "tarball: not found"), ("e", "no evidence")]
    assert samples.count() == 6
    got = json.loads(reports.report_json(samples, findings).first().document)
    assert got == {"malicious": 3, "caught": 2, "recall_pct": 200 / 3, "benign": 1, "flagged": 0, "fp_pct": 0.0, "benign_blocked": 0, "errors": 2}
    views = reports.views(samples, findings, "all")
    assert list(views) == ["report", "rules", "misses", "rules on misses", "sweep", "ablation", "promotion"]
    grid = [tuple(r)[:3] for r in views["sweep"].collect()]
    assert len(grid) == 24 and grid == sorted(grid)
    rules = [(-r.malicious, r.rule) for r in views["rules"].collect()]
    assert rules and rules == sorted(rules) and rules[0][0] == -2
    assert [tuple(r) for r in views["misses"].collect()] == [("silent", 1)]
    with pytest.raises(ValueError, match="none of"):
        reports.views(samples, findings, "other")
    assert command.main(["evaluate", "--manifest", manifest, "--root", root]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:3] == ["== report ==", "\t".join(reports.FIELDS), "3\t2\t66.67\t1\t0\t0.00\t0\t2"]


def test_evaluate_nothing(spark, tmp_path):
    """An empty manifest, or one whose evidence is missing, gives zeros."""
    root = tmp_path / "root"
    root.mkdir()
    (root / "other").write_text("x")
    (tmp_path / "m.tsv").write_text("# none\n")
    samples, findings = command.evidence(spark, str(tmp_path / "m.tsv"), str(root))
    got = json.loads(reports.report_json(samples, findings).first().document)
    assert set(got) == set(reports.FIELDS) and not any(got.values())
    (tmp_path / "m.tsv").write_text("npm\ta\tbenign\tno.tgz\n")
    samples, findings = command.evidence(spark, str(tmp_path / "m.tsv"), str(root))
    assert [tuple(r)[3:] for r in reports.views(samples, findings, "sweep")["sweep"].collect()] == [(0.0, 0.0, 0)] * 24


def test_score(spark, tmp_path, capsys):
    _, root = samples_of(tmp_path)
    assert command.main(["score", "--tarball", f"{root}/a.tgz", "--name", "a"]) == 4
    told = json.loads(capsys.readouterr().out)
    assert told["decision"] == "block" and told["artifact"]["name"] == "a" and told["artifact"]["digest"].startswith("sha256:") and told["signals"]
    rules = ",".join(s["rule"] for s in told["signals"])
    assert command.main(["score", "--tarball", f"{root}/a.tgz", "--disable-rule", f" {rules},"]) == 0
    assert command.main(["score", "--tarball", f"{root}/a.tgz", "--triage", "mock"]) == 4
    capsys.readouterr()
    assert command.main(["score", "--trace", f"{root}/t.json"]) == 0
    assert json.loads(capsys.readouterr().out)["artifact"]["digest"] == ""
    assert command.main(["score"]) == 2
    assert command.main(["score", "--tarball", f"{root}/none"]) == 1


def test_sandbox(spark, tmp_path):
    root = tmp_path / "res"

    def put(path, data):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("d/", b"")
        z.writestr("d/x", b"abc")
    put("@a b+c/results.json", TRACE.encode())
    put("@a b+c/s/results.json", b"{}")
    put("@a b+c/l/1/runsc.log.boot", b"short\n")
    put("@a b+c/l/2/runsc.log.boot", b"open a\nconnect b\n")
    put("@a b+c/fw/write_buffers_.zip", zipped.getvalue())
    put("kept/strace.log.gz", gzip.compress(b"exec c\n"))
    put("kept/write_buffers.zip", b"broken")
    put("kept/static.json", b"{}")
    put("kept/l/runsc.log.boot", b"not at its place\n")
    put("stray.txt", b"")
    where = str(root)
    found = {(r.name, r.kind): r.path.rsplit("/", 2)[1:] for r in sandbox.outputs(spark, where).collect()}
    assert found == {
        ("@a b+c", "trace"): ["@a b+c", "results.json"], ("@a b+c", "static"): ["s", "results.json"], ("@a b+c", "strace"): ["2", "runsc.log.boot"], ("@a b+c", "writes"): ["fw", "write_buffers_.zip"],
        ("kept", "strace"): ["kept", "strace.log.gz"], ("kept", "writes"): ["kept", "write_buffers.zip"], ("kept", "static"): ["kept", "static.json"],
    }
    assert sorted(map(tuple, sandbox.syscall_lines(spark, where).collect())) == [("@a b+c", "connect b"), ("@a b+c", "open a"), ("kept", "exec c")]
    written = {r.name: (r.member, r.size, r.content, r.error is None) for r in sandbox.written_files(spark, where).collect()}
    assert written == {"@a b+c": ("d/x", 3, b"abc", True), "kept": (None, None, None, False)}
    traces = tables.traces(sandbox.sandbox_traces(spark, where, "npm"))
    assert [r.digest for r in traces.collect()] == ["@a b+c"]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "@a b+c.log").write_text("Install succeeded\nx\nagain: Install succeeded\n")
    (logs / "kept.log").write_text("Install failed\n")
    installed = sandbox.installs(spark, str(logs))
    assert {r.name: r.install_ok for r in installed.collect()} == {"@a b+c": 2, "kept": 0}
    decided = spark.createDataFrame([("@a b+c", "block", [("s", "r2", "high"), ("s", "r1", "medium"), ("s", "r2", "high"), ("s", "r0", "low")])], "digest string, decision string, signals array<struct<stage:string,rule:string,severity:string>>")
    names = spark.createDataFrame([("@a b+c",), ("kept",)], "name string")
    assert sorted(map(tuple, sandbox.outcomes(names, traces, decided, installed).collect())) == [("@a b+c", "block", "s:r1,s:r2", 2), ("kept", "NO_TRACE", "", 0)]
