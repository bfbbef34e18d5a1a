"""Archives, tables, stores, splits and streams."""

import hashlib
import hmac
import io
import json
import tarfile
import uuid
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from palisade.functions import ed25519
from palisade.functions.scalars import last_json_object
from palisade.operators.decide import policies
from palisade.plans import splits
from palisade.plans.scoring import admit
from palisade.sources import packages, sinks, tables
from palisade.streaming import admission


def tgz(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
        t.addfile(tarfile.TarInfo("package/dir"))
    return out.getvalue()


def wheel(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_unpack():
    assert packages.unpack("npm", tgz([("package/a.js", b"1"), ("./package/b/../c.js", b"2"), ("../../etc/x", b"3")]))[:3] == [("a.js", b"1", 1, False), ("c.js", b"2", 1, False), ("etc/x", b"3", 1, False)]
    assert [x[0] for x in packages.unpack("pypi", tgz([("x-1.0/setup.py", b""), ("top", b"")]))][:2] == ["setup.py", "top"]
    assert [x[0] for x in packages.unpack("pypi", wheel([("pkg/a.py", b""), ("x.dist-info/METADATA", b"")]))] == ["a.py", "METADATA"]
    big = packages.unpack("npm", tgz([("package/big", b"x" * (packages.KEPT + 5))]))[0]
    assert (len(big[1]), big[2], big[3]) == (packages.KEPT, packages.KEPT + 5, True)


def test_unpacked(spark, tmp_path, monkeypatch):
    (tmp_path / "a.tgz").write_bytes(tgz([("package/package.json", b"{}"), ("package/i.js", b"eval(atob('x'))")]))
    (tmp_path / "b.tgz").write_bytes(b"no archive")
    arts = packages.read_archives(spark, str(tmp_path), "npm")
    rows = packages.unpacked(arts)
    assert {r.path for r in packages.files_of(rows).collect() if r.size} == {"package.json", "i.js"}
    bad = packages.unpack_findings(rows).collect()
    assert [(r.rule, r.severity) for r in bad] == [("unpack-failed", "medium")]
    named = arts.withColumn("name", F.col("filename")).withColumn("version", F.lit("1")).withColumn("seq", F.lit(1).cast("long"))
    history = spark.createDataFrame([], "ecosystem string, name string, version string, digest string, decision string, seq long")
    got = {r.name: r.decision for r in admit(named.select("digest", "ecosystem", "name", "version", "seq"), rows, history, policies(spark)).collect()}
    assert got == {"a.tgz": "block", "b.tgz": "allow"}


def test_limits(monkeypatch):
    monkeypatch.setattr(packages, "MAX_FILES", 2)
    import pytest

    with pytest.raises(ValueError, match="too many"):
        packages.unpack("npm", tgz([(f"package/{i}", b"") for i in range(4)]))
    monkeypatch.setattr(packages, "MAX_FILE", 3)
    with pytest.raises(ValueError, match="too large"):
        packages.unpack("npm", tgz([("package/a", b"1234")]))


def test_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# note\n\nnpm\ta\tmalicious\tx.tgz\t-\npypi\tb\tbenign\nshort\tline\nnpm\tc\tbenign\t-\tt.json\n")
    m = tables.manifest(spark, str(tmp_path / "m.tsv"))
    assert sorted(map(tuple, m.collect()), key=str) == [("npm", "a", "malicious", "x.tgz", None), ("npm", "c", "benign", None, "t.json"), ("pypi", "b", "benign", None, None)]
    archives = spark.createDataFrame([("x.tgz", b"1")], "path string, content binary")
    jsons = spark.createDataFrame([], "path string, json string")
    assert {r.name: r.error for r in tables.samples(m, archives, jsons).collect()} == {"a": None, "b": "no evidence", "c": "trace: not found"}
    (tmp_path / "p.tsv").write_text("npm\tx-y-z\t2025-01-02\nbad\n")
    assert tables.pool(spark, str(tmp_path / "p.tsv")).first().first_seen == date(2025, 1, 2)
    tree = spark.createDataFrame([("s/npm/malicious_intent/x/1/2024-05-06-x.zip",), ("s/npm/malicious_intent/x/2/2023-01-01-x.zip",), ("s/npm/compromised_lib/y/1/2024-05-06-y.zip",), ("a.txt",)], "value string")
    assert [tuple(r) for r in splits.earliest_dates(tables.dataset_listing(tree, "npm")).collect()] == [("npm", "x", date(2023, 1, 1))]
    log = spark.createDataFrame([("1.250 src=10.0.0.2 orig_dst=1.2.3.4:443 TLS sni=a.example DECRYPTED=b'GET /'",), ("1.5 src=10.0.0.2 orig_dst=1.2.3.4:80 plaintext=b'x TLS '",), ("junk",)], "value string")
    assert [(r.at, r.tls, r.sni, r.decrypted, r.plaintext) for r in tables.sink_log(log).collect()] == [(1.25, True, "a.example", "b'GET /'", None), (1.5, False, None, None, "b'x TLS '")]
    dns = spark.createDataFrame([("1.250 10.0.0.2 a.example type=1 -> SINK",)], "value string")
    assert tuple(tables.dns_log(dns).first()) == (1.25, "10.0.0.2", "a.example", "1", "SINK")
    (tmp_path / "r.jsonl").write_text('{"name":"a","eco":"npm","decision":"block","rules":"x,y"}\n')
    assert tables.earlier_results(spark, str(tmp_path / "r.jsonl")).first().rules == ["x", "y"]
    raw = spark.createDataFrame([("a", "npm", "{}"), ("b", "npm", "{bad"), ("c", "npm", '{"Analysis": {"install": {"Status": "ok", "More": 1}}}')], "digest string, ecosystem string, json string")
    assert [r.digest for r in tables.traces(raw).collect()] == ["c"]
    (tmp_path / "top.txt").write_text("b\na\n\nb\n")
    assert [r.name for r in tables.top_names(spark, str(tmp_path / "top.txt")).orderBy("rank").collect()] == ["b", "a"]


def test_stores(spark, tmp_path):
    d = lambda c: f"sha256:{c * 64}"
    rows = spark.createDataFrame([(d("a"), b"1"), (d("a"), b"1"), (d("b"), b"2"), ("sha256:zz", b"3")], "digest string, content binary")
    path = str(tmp_path / "artifacts")
    sinks.put_artifacts(rows, path)
    sinks.put_artifacts(rows, path)
    assert spark.read.parquet(path).count() == 2
    assert sinks.get_artifacts(spark, path, rows.select("digest").limit(1)).first().content == b"1"
    loc = str(tmp_path / "loc")
    sinks.put_locators(spark.createDataFrame([("/p", d("a"))], "path string, digest string"), loc)
    sinks.put_locators(spark.createDataFrame([("/p", d("b")), ("/q", "none")], "path string, digest string"), loc)
    assert [tuple(r) for r in spark.read.parquet(loc).collect()] == [("/p", d("a"))]
    meta = str(tmp_path / "meta")
    at = lambda m: datetime(2024, 1, 1, 0, m)
    sinks.put_metadata(spark.createDataFrame([("u", "old", "t", at(0)), ("u", "new", "t", at(5)), ("v", "x", "t", at(0))], "url string, body string, content_type string, fetched_at timestamp"), meta)
    got = {r.url: (r.body, r.fresh) for r in sinks.get_metadata(spark, meta, F.lit(datetime(2024, 1, 1, 0, 6)), 120).collect()}
    assert got == {"u": ("new", True), "v": ("x", False)}


def verdict_rows(spark):
    schema = "digest string, ecosystem string, name string, version string, decision string, reason string, signals array<struct<stage:string,rule:string,severity:string,description:string,evidence:string>>, decided_at timestamp, engine string, rules_version string"
    return spark.createDataFrame([("sha256:a", "npm", "x", "1", "block", "r", [("static", "k", "high", "d", None)], datetime(2024, 1, 1), "e", "v"), ("sha256:b", "npm", "y", "1", "allow", "r", None, datetime(2024, 1, 1), "e", "v")], schema)


def test_seals(spark):
    rows, signer = verdict_rows(spark), sinks.HmacSigner(b"key")
    plain, signed = sinks.sealed(rows), sinks.sealed(rows, signer)
    assert {r.digest for r in sinks.opened(signed, signer).collect()} == {"sha256:a", "sha256:b"}
    assert sinks.opened(plain).filter("decision = 'block'").first().signals[0].rule == "k"
    assert sinks.opened(plain, signer).count() == sinks.opened(signed).count() == sinks.opened(signed, sinks.HmacSigner(b"other")).count() == 0
    forged = signed.withColumn("document", F.replace("document", F.lit("block"), F.lit("allow")))
    assert {r.digest for r in sinks.opened(forged, signer).collect()} == {"sha256:b"}
    moved = signed.withColumn("digest", F.lit("sha256:a"))
    assert sinks.opened(moved, signer).count() == 1
    body = json.loads(sinks.refusals(rows).first().body)
    assert body["decision"] == "block" and body["artifact"]["name"] == "x"
    assert [r[0] for r in rows.select(sinks.exit_code(F.col("decision"))).collect()] == [4, 0]


def test_pages(spark, tmp_path):
    doc = '{"name":"a<b","files":[{"filename":"x.whl","url":"u?a=1&b","hashes":{"sha256":"00"},"requires-python":">=3","yanked":false},{"filename":"y","url":"u#z","hashes":{}}]}'
    df = spark.createDataFrame([(doc,)], "raw string").select(tables.package_index(F.col("raw")).alias("p"))
    page = df.select(sinks.index_page(F.col("p.name"), F.col("p.files"))).first()[0]
    assert '<title>Links for a&lt;b</title>' in page and '<a href="u?a=1&amp;b#sha256=00" data-requires-python="&gt;=3">x.whl</a><br/>\n' in page and '<a href="u#z">y</a><br/>\n' in page
    sinks.write_results(spark.createDataFrame([("a", "block", "x", True)], "name string, decision string, rules string, install_ok boolean"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == "a\tblock\tx\ttrue"
    sinks.write_raw(spark.createDataFrame([("m", "p")], "model string, prompt string"), str(tmp_path / "raw"))
    assert json.loads(spark.read.text(str(tmp_path / "raw")).first().value) == {"model": "m", "prompt": "p"}


def test_splits(spark):
    rows = [("npm", f"bulk{i}", date(2025, 3, 1)) for i in range(10)] + [("npm", "bulk0", date(2025, 3, 1))] + [("npm", f"a-b-{i}", date(2025, 1 + 6 * (i == 2), 1 + i)) for i in range(3)] + [("npm", "c-d-1", date(2025, 2, 1)), ("npm", "c-d-2", date(2026, 2, 1)), ("pypi", "solo", date(2026, 1, 1)), ("npm", "one-two", date(2025, 1, 1))]
    pool = spark.createDataFrame(rows[:10] + rows[11:], "ecosystem string, name string, first_seen date")
    c = splits.campaigns(pool)
    ids = {r.name: r.campaign_id for r in c.collect()}
    assert len({ids[f"bulk{i}"] for i in range(10)}) == 1 and len({ids[f"a-b-{i}"] for i in range(3)}) == 1 and ids["c-d-1"] != ids["c-d-2"] and ids["solo"] == "solo"
    s = splits.temporal_split(pool, c, "2025-06-01")
    assert {r.name for r in s.filter("side = 'test'").collect()} == {"c-d-2", "solo"} and {r.name for r in s.filter("moved").collect()} == {"a-b-2"}
    assert splits.leaks(s).isEmpty()
    t = splits.campaign_stats(c).first()
    assert (t.packages, t.campaigns, t.in_multi, t.multi) == (17, 6, 13, 2)
    assert splits.largest_campaigns(c).first().n == 10
    sizes = {"npm": 5, "pypi": 5}
    parts = [{r.name for r in splits.campaign_slice(pool, c, k, sizes).collect()} for k in (1, 2, 3, 4)]
    assert sum(map(len, parts)) == len(set().union(*parts)) == 17
    assert all(len({ids[n] for n in p} & {ids[n] for n in q}) == 0 for i, p in enumerate(parts) for q in parts[:i])
    exact = splits.campaign_slice(pool, c, 1, sizes, strict_compat=True)
    assert exact.filter("ecosystem = 'npm'").count() == 5
    assert [r.name for r in splits.page(pool, 1, 2, "name").collect()] == ["a-b-1", "a-b-2"]


def test_chained_campaigns(spark):
    """Days and families that overlap in turn are one campaign."""
    rows = [("npm", f"f{k // 3}-x-{k}", date(2025, 1, 1 + (k + 1) // 3)) for k in range(24)]
    c = splits.campaigns(spark.createDataFrame(rows, "ecosystem string, name string, first_seen date"), bulk=3)
    assert c.select("campaign_id").distinct().count() == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda v, d, t: json.dumps({"ecosystem": "npm", "name": "x", "version": v, "digest": d, "decision": "allow", "seen_at": f"2024-01-01T00:00:0{t}Z"})
    (src / "1.json").write_text(row("1", "a", 1) + "\n" + row("2", "b", 2) + "\n")
    judged = tmp_path / "verdicts"

    def go():
        q = admission.history(admission.requests(spark, str(src), per_batch=1)).writeStream.format("parquet").option("path", str(tmp_path / "h")).option("checkpointLocation", str(tmp_path / "hc")).trigger(availableNow=True).start()
        q.awaitTermination()
        admission.judge_batches(admission.requests(spark, str(src)), lambda df: df.select("digest", "decision"), str(judged), str(tmp_path / "jc")).awaitTermination()

    go()
    (src / "2.json").write_text(row("3", "b", 3) + "\n" + row("4", "c", 4) + "\n")
    go()
    got = sorted((r.seq, r.version, r.digest) for r in spark.read.schema(admission.HISTORY).parquet(str(tmp_path / "h")).collect())
    assert got == [(0, "1", "a"), (1, "2", "b"), (2, "4", "c")]
    assert sorted(r.digest for r in spark.read.parquet(str(judged)).collect()) == ["a", "b", "c"]


def test_ed25519(spark):
    """Keys and signatures equal the JDK's; what isn't signed by the key is as if missing."""
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    jdk = spark._jvm.java.security
    for n in range(8):
        seed, message = bytes([n] * 32), ("é" * n).encode()
        key = jdk.KeyFactory.getInstance("Ed25519").generatePrivate(jdk.spec.EdECPrivateKeySpec(jdk.spec.NamedParameterSpec.ED25519, seed))
        signature = jdk.Signature.getInstance("Ed25519")
        signature.initSign(key)
        signature.update(message)
        made = ed25519.sign(seed, message)
        assert bytes(signature.sign()) == made
        public = ed25519.public_key(seed)
        assert ed25519.check(public, message, made)
        assert not ed25519.check(public, message + b"x", made) and not ed25519.check(public, message, made[:32] + bytes([made[32] ^ 1]) + made[33:])
        late = int.from_bytes(made[32:], "little") + ed25519.ORDER
        assert not ed25519.check(public, message, made[:32] + late.to_bytes(32, "little")) and not ed25519.check(public, message, b"")
    assert ed25519.unpacked(b"\xff" * 32) is None and ed25519.unpacked(b"\x02" + b"\0" * 31) is None
    rows, signer = verdict_rows(spark), sinks.Ed25519Signer(b"s" * 32)
    signed, checker = sinks.sealed(rows, signer), signer.checker()
    assert sinks.opened(signed, checker).count() == 2
    forged = signed.withColumn("document", F.replace("document", F.lit("block"), F.lit("allow")))
    assert {r.digest for r in sinks.opened(forged, checker).collect()} == {"sha256:b"}
    assert sinks.opened(signed, sinks.Ed25519Signer(b"t" * 32)).count() == 0
    with pytest.raises(TypeError):
        checker.sign("x")
    assert not checker.check("x", "no hex")


def test_seals_are_made_and_parsed_once(spark, tmp_path):
    folder = str(tmp_path)

    class Counting(sinks.HmacSigner):
        """Leaves a file for each call."""

        def sign(self, text):
            open(f"{folder}/sign-{uuid.uuid4().hex}", "w").close()
            return sinks.HmacSigner.sign(self, text)

        def check(self, text, signature):
            open(f"{folder}/check-{uuid.uuid4().hex}", "w").close()
            return sinks.HmacSigner.sign(self, text) == signature

    rows, signer = verdict_rows(spark), Counting(b"key")
    assert signer.sign("x") == hmac.new(b"key", b"x", hashlib.sha256).hexdigest()
    signed = sinks.sealed(rows, signer)
    odd = spark.createDataFrame([("sha256:c", d) for d in (None, "", "{", "[]", '{"signature":null}', '{"signature":"x"}', '{"verdict":"{}","algorithm":"hmac-sha256","key_id":"0","signature":"x"}')], "digest string, document string")
    opened = sinks.opened(signed.withColumn("document", F.replace("document", F.lit("block"), F.lit("allow"))).unionByName(odd), signer)
    assert [(r.digest, r.decision) for r in opened.collect()] == [("sha256:b", "allow")]
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert (calls.count("sign"), calls.count("check")) == (1 + 2, 2)
    # names of JSON functions in the plan, with those in lists of columns
    plan = opened._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.count("get_json_object(") == 1 and plan.count("StructsToJsonEvaluator(") == 2


def test_judgments_in_noise(spark):
    texts = ['x { {"a":1} y', '{"a":1} {"b":"}"} {', '{"a":{"b":2}}', "{ \\{ }", 'a "{" {"c":1}', "}", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", last_json_object("t").alias("o"))
    assert [r.o for r in df.orderBy("i").collect()] == ['{"a":1}', '{"b":"}"}', '{"a":{"b":2}}', "{ \\{ }", '{"c":1}', None, None, None]
