"""Queries of archives, stores, texts of registries, listings, seals, model judgments and version findings."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import fixed
from palisade.functions import scalars as S
from palisade.operators import advisories, versions
from palisade.operators.decide import policies
from palisade.operators.triage import TextModel, triage_findings
from palisade.plans import evaluation, scoring, splits
from palisade.sources import packages, sinks, tables
from palisade.sources.scratch import cut, shared_dir

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _new(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/palisade-{uuid.uuid4().hex}"


def _written(lines: DataFrame) -> str:
    """The folder that holds a column of lines as text."""
    path = _new(lines.sparkSession)
    lines.write.text(path)
    return path


def _packed(kind: int, text: str) -> bytes:
    """A document as a package: npm tarball, wheel, sdist, or its bare text, which is no archive."""
    data, out = text.encode(), io.BytesIO()
    if kind == 3:
        return data
    if kind == 1:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("pkg/", b"")
            z.writestr("pkg/text.txt", data)
            z.writestr("top.txt", b"x")
        return out.getvalue()
    root = "package" if kind == 0 else "pkg-1.0"
    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as t:
        for name, content in ((f"./{root}/text.txt", data), (f"{root}/lib/../top.txt", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo(f"{root}/folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _pack(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([_packed(k, t) for k, t in zip(kinds, texts, strict=True)])


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an archive; wheels are told by name or by their first bytes."""
    kind = F.expr("cast(doc_id % 4 as int)")
    name = F.expr("CASE doc_id % 8 WHEN 1 THEN 'x-1.0-py3-none-any.whl' WHEN 2 THEN 'x-1.0.tar.gz' END")
    docs = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("string").alias("digest"), F.when(kind == 0, "npm").otherwise("pypi").alias("ecosystem"), name.alias("filename"), _pack(kind, "text").alias("content"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 4 < 3)
SELECT doc_id, 'text.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, octet_length(encode(text)) > 4194304 AS truncated, sha256(text[:4194304]) AS hash, CAST(0 AS INTEGER) AS file_idx FROM d
UNION ALL SELECT doc_id, 'top.txt', 1, false, sha256('x'), 1 FROM d""")
def archive_files(spark, sf_dir):
    files = packages.files_of(packages.unpacked(_archives(spark, sf_dir)))
    return files.select(F.col("digest").cast("long").alias("doc_id"), "path", "size", "truncated", F.sha2("content", 256).alias("hash"), "file_idx")


@query(f"SELECT doc_id, '{fixed.GATE_RULES['unpack'][0]}' AS rule, '{fixed.GATE_RULES['unpack'][1]}' AS severity, true AS told FROM documents WHERE doc_id % 4 = 3")
def unpack_failures(spark, sf_dir):
    found = packages.unpack_findings(packages.unpacked(_archives(spark, sf_dir)))
    return found.select(F.col("digest").cast("long").alias("doc_id"), "rule", "severity", (F.length("evidence") > 0).alias("told"))


@query("SELECT 'sha256:' || sha256(text) AS digest, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS size, CAST(1 AS BIGINT) AS copies FROM documents WHERE text IS NOT NULL AND lang = 'en' GROUP BY 1")
def artifact_store(spark, sf_dir):
    """All texts are put, then the English ones once more; a digest is stored once."""
    content = F.col("text").cast("binary")
    every = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(S.digest(content).alias("digest"), content.alias("content"), "lang")
    path = _new(spark)
    sinks.put_artifacts(every.drop("lang"), path)
    english = every.filter("lang = 'en'").drop("lang")
    sinks.put_artifacts(english, path)
    held = sinks.get_artifacts(spark, path, english)
    return held.groupBy("digest").agg(F.max(F.octet_length("content")).cast("long").alias("size"), F.count("*").alias("copies"))


@query("SELECT 'u' || user_id AS url, max(ts) AS fetched_at, max(ts) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY AS fresh FROM events GROUP BY user_id")
def metadata_store(spark, sf_dir):
    """Every event is an answer; the last of each address counts, stale or not."""
    path = _new(spark)
    answers = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("props").alias("body"), F.lit("application/json").alias("content_type"), F.col("ts").cast("timestamp").alias("fetched_at"))
    sinks.put_metadata(answers.filter("body IS NOT NULL"), path)
    sinks.put_metadata(answers.filter("body IS NULL"), path)
    got = sinks.get_metadata(spark, path, F.lit("2024-01-20 00:00:00").cast("timestamp"), 3 * 86400)
    return got.select("url", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "fresh")


@query("SELECT DISTINCT 'c' || o_custkey AS path, 'sha256:' || sha256(CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END || o_custkey) AS digest FROM orders")
def locator_store(spark, sf_dir):
    """Even customers come first and keep their digest as all come again; what is no digest is refused."""
    path = _new(spark)
    keys = read(spark, sf_dir, "orders").select("o_custkey").distinct()
    of = lambda p: S.digest(F.concat(F.lit(p), F.col("o_custkey")).cast("binary")).alias("digest")
    name = F.concat(F.lit("c"), F.col("o_custkey")).alias("path")
    sinks.put_locators(keys.filter("o_custkey % 2 = 0").select(name, of("a")).unionByName(keys.select(F.concat(F.lit("bad"), F.col("o_custkey")).alias("path"), F.lit("sha256:00").alias("digest"))), path)
    sinks.put_locators(keys.select(name, of("b")), path)
    return spark.read.parquet(path)


def _verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a verdict."""
    signal = F.struct(F.lit("static").alias("stage"), F.col("event_type").alias("rule"), F.lit("high").alias("severity"), F.col("props").alias("description"), F.lit('a "quoted" é').alias("evidence"))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), F.col("event_id")).alias("digest"), F.lit("npm").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.col("event_id").cast("string").alias("version"),
        F.expr("CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'quarantine' ELSE 'allow' END").alias("decision"), F.lit("r").alias("reason"), F.array(signal).alias("signals"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("decided_at"), F.lit("e").alias("engine"), F.lit("1").alias("rules_version"),
    )


@query("""SELECT 'd' || event_id AS digest, CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'quarantine' ELSE 'allow' END AS decision, event_type AS rule, props AS description, 'a "quoted" é' AS evidence
FROM events WHERE event_id % 5 > 1 OR (event_id % 5 = 1 AND event_type <> 'error')""")
def sealed_verdicts(spark, sf_dir):
    """Of five documents one is unsigned, in one a block is forged into an allow; both are as if missing."""
    signer, rows = sinks.HmacSigner(b"a key of the query"), _verdict_rows(spark, sf_dir)
    nth = F.substring("digest", 2, 20).cast("long") % 5
    signed = sinks.sealed(rows, signer).filter(nth > 0)
    forged = F.when(nth == 1, F.replace("document", F.lit("block"), F.lit("allow"))).otherwise(F.col("document"))
    kept = sinks.opened(signed.withColumn("document", forged).unionByName(sinks.sealed(rows).filter(nth == 0)), signer)
    first = F.col("signals")[0]
    return kept.select("digest", "decision", first["rule"].alias("rule"), first["description"].alias("description"), first["evidence"].alias("evidence"))


@query("""SELECT 'd' || event_id AS digest, 'artifact refused by policy' AS error, CASE event_type WHEN 'error' THEN 'block' ELSE 'quarantine' END AS decision, CAST(user_id AS VARCHAR) AS name, event_type AS rule FROM events WHERE event_type IN ('error', 'purchase')""")
def refusal_bodies(spark, sf_dir):
    at = lambda p: F.get_json_object("body", p)
    return sinks.refusals(_verdict_rows(spark, sf_dir)).select("digest", at("$.error").alias("error"), at("$.decision").alias("decision"), at("$.artifact.name").alias("name"), at("$.signals[0].rule").alias("rule"))


@query("SELECT 'd' || event_id AS digest, CAST(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 0 END AS INTEGER) AS code, event_type NOT IN ('error', 'purchase') AS clear FROM events")
def exit_codes(spark, sf_dir):
    return _verdict_rows(spark, sf_dir).select("digest", sinks.exit_code(F.col("decision")).alias("code"), S.clears(F.col("decision")).alias("clear"))


@query("""SELECT p_partkey, '<!DOCTYPE html>' || chr(10) || '<html><head><meta name="pypi:repository-version" content="1.0"><title>Links for ' || p_name || '</title></head><body>' || chr(10)
|| '<a href="https://mirror.example/' || p_partkey || '.whl#sha256=' || md5(p_name) || '" data-requires-python="&gt;=3">' || p_partkey || '.whl</a><br/>' || chr(10)
|| '<a href="https://other.example/&amp;#z">b</a><br/>' || chr(10) || '</body></html>' || chr(10) AS page FROM part""")
def index_pages(spark, sf_dir):
    """A project's JSON index, its files moved to a mirror, as a page."""
    raw = F.expr("""concat('{"name":"', p_name, '","files":[{"filename":"', p_partkey, '.whl","url":"https://files.example/', p_partkey, '.whl","hashes":{"sha256":"', md5(p_name), '"},"requires-python":">=3"},{"filename":"b","url":"https://other.example/&#z","hashes":{}}]}')""")
    rows = read(spark, sf_dir, "part").select("p_partkey", tables.package_index(raw).alias("i"))
    files = S.rewrite_file_urls(F.col("i.files"), "https://files.example/", "https://mirror.example/")
    return rows.select("p_partkey", sinks.index_page(F.col("i.name"), files).alias("page"))


@query("""SELECT event_id, '{"dist":{"tarball":"https://mirror/' || event_id || '.tgz"},"list":["https://mirror/",{"x":"see https://up/"}],"props":' || replace(props, ': ', ':') || '}' AS document FROM events""")
def packument_urls(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.expr("""concat('{"dist": {"tarball": "https://up/', event_id, '.tgz"}, "list": ["https://up/", {"x": "see https://up/"}], "props": ', props, '}')""").alias("d"))
    return rows.select("event_id", S.rewrite_prefix("https://up/", "https://mirror/")("d").alias("document"))


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS name, CASE WHEN page_id % 3 = 1 THEN 'x-' || page_id || '.tgz' WHEN page_id % 3 = 2 THEN 'a/-/b' END AS file FROM pages")
def npm_tarball_paths(spark, sf_dir):
    path = F.expr("CASE page_id % 3 WHEN 0 THEN concat('/-/', url) WHEN 1 THEN concat(url, '/-/x-', page_id, '.tgz') ELSE concat(url, '/-/a/-/b') END")
    split = S.split_npm_tarball(path)
    return read(spark, sf_dir, "pages").select("page_id", split["name"].alias("name"), split["file"].alias("file"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'block' WHEN event_type = 'view' THEN 'allow' END AS decision, CASE WHEN event_type IN ('error', 'view') THEN value END AS confidence, CASE WHEN event_type IN ('error', 'view') THEN 'a } brace, ' || event_id END AS rationale, CASE WHEN event_type IN ('error', 'view') THEN 'x|y' END AS told FROM events""")
def model_outputs(spark, sf_dir):
    """Judgments within noise; clicks give an unknown verdict, purchases an object left open, others none."""
    body = """concat('thinking {"verdict":"block"} then { open ', CASE event_type WHEN 'signup' THEN 'none {}' ELSE concat('{"verdict":"', CASE event_type WHEN 'error' THEN 'block' WHEN 'view' THEN 'allow' WHEN 'click' THEN 'maybe' ELSE '' END, '","confidence":', value, ',"rationale":"a } brace, ', event_id, '","signals":["x","y"]}') END, ' done')"""
    rows = read(spark, sf_dir, "events").select("event_id", S.parse_model_output(F.expr(body)).alias("o"))
    return rows.select("event_id", F.col("o.verdict").alias("decision"), F.col("o.confidence").alias("confidence"), F.col("o.rationale").alias("rationale"), F.array_join("o.signals", "|").alias("told"))


@query("SELECT event_id, event_id % 3 = 0 AS signed FROM events")
def signed_envelopes(spark, sf_dir):
    document = F.expr("""concat('{"verdict":', props, CASE event_id % 3 WHEN 0 THEN ',"signature":"x"}' WHEN 1 THEN ',"signature":null}' ELSE ',"inner":{"signature":"x"}}' END)""")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(S.is_signed_envelope(document), F.lit(False)).alias("signed"))


@query("SELECT doc_id, doc_id % 2 = 0 AND octet_length(encode(coalesce(text, ''))) < 8000 AS is_binary, 'a = \"\"; b = ''' || repeat('y', 198) || '''; c = ' || CASE WHEN doc_id % 3 = 0 THEN '\"\"' ELSE '''z''' END AS stripped FROM documents")
def binary_and_literals(spark, sf_dir):
    """Every other text ends in a NUL byte; literals of more than 200 bytes go."""
    content = F.expr("concat(cast(coalesce(text, '') as binary), if(doc_id % 2 = 0, X'00', X''), cast('end' as binary))")
    literal = F.expr("concat('a = \"', repeat('x', 199), '\"; b = \\'', repeat('y', 198), '\\'; c = ', if(doc_id % 3 = 0, concat('\\'', repeat('é', 100), '\\''), '\\'z\\''))")
    return read(spark, sf_dir, "documents").select("doc_id", S.is_binary(content).alias("is_binary"), S.strip_long_literals(literal).alias("stripped"))


@query("SELECT 'npm' AS ecosystem, 'pkg-' || o_custkey AS name, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_seen FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def listing_dates(spark, sf_dir):
    """Every order is an archive of a dataset's tree; pending ones lie in another branch of it."""
    line = F.expr("concat('samples/npm/', if(o_orderstatus = 'P', 'compromised_lib', 'malicious_intent'), '/pkg-', o_custkey, '/1.0/', date_format(o_orderdate, 'yyyy-MM-dd'), '-pkg-', o_orderkey, '.zip')")
    lines = spark.read.text(_written(read(spark, sf_dir, "orders").select(line.alias("value"))))
    return splits.earliest_dates(tables.dataset_listing(lines, "npm")).withColumn("first_seen", F.col("first_seen").cast("string"))


@query("SELECT 'npm' AS ecosystem, 'p' || o_orderkey AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS first_seen FROM orders WHERE o_orderkey % 5 > 0")
def pool_lines(spark, sf_dir):
    line = F.expr("if(o_orderkey % 5 = 0, concat('npm\t', o_orderkey), concat('npm\tp', o_orderkey, '\t', date_format(o_orderdate, 'yyyy-MM-dd'), '\tmore'))")
    rows = tables.pool(spark, _written(read(spark, sf_dir, "orders").select(line.alias("value"))))
    return rows.withColumn("first_seen", F.col("first_seen").cast("string"))


@query("""WITH m AS (SELECT DISTINCT user_id FROM events)
SELECT 'npm' AS ecosystem, 'u' || user_id AS name, CASE WHEN user_id % 3 = 0 THEN 'malicious' ELSE 'benign' END AS label, CASE WHEN user_id % 2 = 0 THEN user_id || '.tgz' END AS tarball, CASE WHEN user_id % 5 = 0 THEN user_id || '.json' END AS trace,
       CASE WHEN user_id % 2 = 0 AND user_id % 4 > 0 THEN 'tarball: not found' WHEN user_id % 2 > 0 AND user_id % 5 > 0 THEN 'no evidence' END AS error FROM m""")
def manifest_samples(spark, sf_dir):
    """Users as lines of a manifest among comments and short lines; of every other tarball the file is missing."""
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    line = F.expr("concat('npm\tu', user_id, '\t', if(user_id % 3 = 0, 'malicious', 'benign'), '\t', if(user_id % 2 = 0, concat(user_id, '.tgz'), '-'), '\t', if(user_id % 5 = 0, concat(user_id, '.json'), '-'))")
    noise = users.select(F.expr("if(user_id % 2 = 0, concat('# ', user_id), concat('npm\t', user_id))").alias("value"))
    listed = tables.manifest(spark, _written(users.select(line.alias("value")).unionByName(noise)))
    archives = users.filter("user_id % 4 = 0").select(F.concat("user_id", F.lit(".tgz")).alias("path"), F.lit("x").cast("binary").alias("content"))
    texts = users.filter("user_id % 5 = 0").select(F.concat("user_id", F.lit(".json")).alias("path"), F.lit("{}").alias("json"))
    return tables.samples(listed, archives, texts).select("ecosystem", "name", "label", "tarball", "trace", "error")


@query("SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20 OFFSET 10")
def manifest_page(spark, sf_dir):
    """The page is the feature: twenty lines after the first ten."""
    return splits.page(read(spark, sf_dir, "events").select("user_id").distinct(), 10, 20, "user_id")


_RESULTS = "r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'quarantine' WHEN 'signup' THEN 'NO_TRACE' ELSE 'allow' END AS decision, CASE WHEN value > 60 THEN 'a,b' WHEN value > 30 THEN 'a' ELSE '' END AS rules FROM events)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.expr("CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'quarantine' WHEN 'signup' THEN 'NO_TRACE' ELSE 'allow' END")
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), F.lit("npm").alias("eco"), F.lit("t").alias("tag"), decision.alias("decision"), F.expr("CASE WHEN value > 60 THEN 'a,b' WHEN value > 30 THEN 'a' ELSE '' END").alias("rules"))


@query(f"WITH {_RESULTS} SELECT decision, count(*) AS n, (SELECT count(*) FILTER (decision = 'NO_TRACE') * 100.0::DOUBLE / count(*) FROM r) AS trace_loss_pct FROM r GROUP BY decision")
def decision_counter(spark, sf_dir):
    return evaluation.decision_counts(_results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT decision, rules, count(*) AS n FROM r WHERE decision <> 'allow' GROUP BY ALL ORDER BY n DESC, decision, rules LIMIT 20")
def flagged_outcomes(spark, sf_dir):
    return evaluation.flagged_histogram(_results(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT event_id, decision, CAST(len(list_filter(string_split(rules, ','), lambda x: x <> '')) AS INTEGER) AS n_rules FROM r")
def result_files(spark, sf_dir):
    """Results as JSON lines, written and read again."""
    path = _new(spark)
    sinks.write_raw(_results(spark, sf_dir), path)
    return tables.earlier_results(spark, path).select(F.col("name").cast("long").alias("event_id"), "decision", F.size("rules").alias("n_rules"))


@query(f"WITH {_RESULTS} SELECT CAST(event_id AS VARCHAR) AS name, decision, rules, 'true' AS install_ok FROM r")
def result_tables(spark, sf_dir):
    """Results as tab-separated values, written and read again."""
    path = _new(spark)
    sinks.write_results(_results(spark, sf_dir).withColumn("install_ok", F.lit(True)), path)
    return spark.read.schema("name string, decision string, rules string, install_ok string").option("sep", "\t").csv(path).fillna("", ["rules"])


@query("SELECT 'd' || event_id AS digest, 'behavior: ' || CASE WHEN event_id % 3 = 0 THEN 'parse trace' ELSE 'trace has no Analysis section' END AS error FROM events WHERE event_id % 3 < 2")
def trace_failures(spark, sf_dir):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat('{\"Analysis\": ', props) WHEN 1 THEN props ELSE '{\"Analysis\":{\"install\":{\"Status\":\"ok\"}}}' END")
    return tables.trace_errors(read(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("event_id")).alias("digest"), F.lit("npm").alias("ecosystem"), text.alias("json")))


@query("SELECT event_id, 'host' || event_id || '.example' AS name, 'A' AS type, '10.0.0.' || event_id % 250 AS answer FROM events WHERE event_type <> 'view'")
def dns_log_lines(spark, sf_dir):
    line = F.expr("if(event_type = 'view', concat('noise ', event_id), concat('1700000000.5 10.1.1.1 host', event_id, '.example type=A -> 10.0.0.', event_id % 250))")
    parsed = tables.dns_log(read(spark, sf_dir, "events").select(line.alias("value")))
    return parsed.select(F.regexp_extract("name", r"host(\d+)", 1).cast("long").alias("event_id"), "name", "type", "answer")


@query(f"SELECT 'd' || event_id AS digest, '{fixed.GATE_RULES['advisories'][0]}' AS rule, '{fixed.GATE_RULES['advisories'][1]}' AS severity, 'osv: unsupported ecosystem \"' || event_type || '\"' AS evidence FROM events WHERE event_type <> 'view'")
def unanswered_lookups(spark, sf_dir):
    """Views are npm packages without an advisory, all other kinds ecosystems that the database lacks."""
    artifacts = read(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("event_id")).alias("digest"), F.expr("if(event_type = 'view', 'npm', event_type)").alias("ecosystem"), F.lit("n").alias("name"), F.lit("1").alias("version"))
    return advisories.advisory_findings(artifacts, spark.createDataFrame([], tables.OSV)).select("digest", "rule", "severity", "evidence")


_SETUP = """s AS (SELECT source, lag(source) OVER (ORDER BY length(source), source) AS before FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
f AS (SELECT source, lang || '/' || doc_id // 40 AS path, arg_max(sha256(text), doc_id) AS hash FROM documents WHERE source IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT source, 'setup.py', CAST(length(source) AS VARCHAR) || CASE WHEN source LIKE '%5' THEN 'x' ELSE '' END FROM s WHERE source NOT LIKE '%2')"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pairs and files: each source is a version of the one before it, with a setup.py in all but some."""
    from pyspark.sql import Window

    d = read(spark, sf_dir, "documents").filter("source IS NOT NULL")
    sources = d.select("source").distinct()
    texts = d.select(F.col("source").alias("digest"), F.concat("lang", F.lit("/"), F.expr("cast(doc_id div 40 as string)")).alias("path"), F.col("text").cast("binary").alias("content"), F.col("doc_id").cast("int").alias("file_idx"))
    setup = F.expr("concat(length(source), if(source LIKE '%5', 'x', ''))")
    files = texts.unionByName(sources.filter("source NOT LIKE '%2'").select(F.col("source").alias("digest"), F.lit("setup.py").alias("path"), setup.cast("binary").alias("content"), F.lit(-1).alias("file_idx"))).withColumn("ecosystem", F.lit("pypi"))
    # one row a source
    pairs = sources.select(F.col("source").alias("digest"), F.lag("source").over(Window.orderBy(F.length("source"), "source")).alias("prev_digest")).filter("prev_digest IS NOT NULL")
    return pairs.withColumn("prev_version", F.col("prev_digest")), files


@query(f"""WITH {_SETUP} SELECT s.source AS digest, CASE WHEN p.hash IS NULL THEN '{fixed.DIFF_RULES["setup-added"][0]}' ELSE '{fixed.DIFF_RULES["setup-changed"][0]}' END AS rule, CASE WHEN p.hash IS NULL THEN '{fixed.DIFF_RULES["setup-added"][1]}' ELSE '{fixed.DIFF_RULES["setup-changed"][1]}' END AS severity
FROM s JOIN f c ON c.source = s.source AND c.path = 'setup.py' LEFT JOIN f p ON p.source = s.before AND p.path = 'setup.py' WHERE s.before IS NOT NULL AND p.hash IS DISTINCT FROM c.hash""")
def setup_diff(spark, sf_dir):
    pairs, files = _versions(spark, sf_dir)
    return versions.setup_changes(pairs, files, versions.file_changes(pairs, files)).select("digest", "rule", "severity")


@query(f"""WITH {_SETUP}, sides AS (SELECT s.source AS digest, s.before, path, hash AS now, NULL AS old FROM s JOIN f USING (source) WHERE before IS NOT NULL UNION ALL SELECT s.source, s.before, path, NULL, hash FROM s JOIN f ON f.source = before),
b AS (SELECT digest, before, path, max(now) AS now, max(old) AS old FROM sides GROUP BY ALL)
SELECT digest, before AS prev_version, coalesce(string_agg(path, '|' ORDER BY path) FILTER (old IS NULL), '') AS added, coalesce(string_agg(path, '|' ORDER BY path) FILTER (now IS NULL), '') AS removed, coalesce(string_agg(path, '|' ORDER BY path) FILTER (now <> old), '') AS modified FROM b GROUP BY ALL""")
def diff_summaries(spark, sf_dir):
    pairs, files = _versions(spark, sf_dir)
    told = versions.diff_summary(pairs, versions.file_changes(pairs, files))
    return told.select("digest", "prev_version", *[F.array_join(c, "|").alias(c) for c in ("added", "removed", "modified")])


@query("SELECT CAST(event_id AS VARCHAR) AS version, event_type AS digest, event_id AS seq FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def package_log(spark, sf_dir):
    """One package's entries; the package is the argument of the operator."""
    e = read(spark, sf_dir, "events")
    history = e.select(F.lit("npm").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.col("event_id").cast("string").alias("version"), F.col("event_type").alias("digest"), F.col("event_id").alias("seq"))
    return scoring.package_history(history, "npm", str(e.agg(F.min("user_id")).first()[0])).select("version", "digest", "seq")


def _opinion(prompt: str) -> str:
    """A model that clears whatever isn't told as critical, and fails on packages with a low finding only."""
    if '"severity":"critical"' in prompt:
        return 'well {"verdict":"block","confidence":0.9,"rationale":"critical","signals":["s"]}'
    if '"severity":"high"' in prompt:
        return 'well {"verdict":"allow","confidence":0.5,"rationale":"fine","signals":[]}'
    if '"severity":"low"' in prompt:
        raise ValueError("no answer")
    return "no judgment"


_KINDS = "CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'info' END"


@query(f"""WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS digest, {_KINDS} AS s FROM events)
SELECT digest, 'llm-block' AS rule, 'high' AS severity, 'stub triage: critical' AS description, 's' AS evidence FROM u WHERE s = 'critical'
UNION ALL SELECT digest, 'llm-allow', 'info', 'stub triage: fine', '' FROM u WHERE s = 'high'
UNION ALL SELECT digest, '{fixed.GATE_RULES["model"][0]}', '{fixed.GATE_RULES["model"][1]}', '{fixed.GATE_RULES["model"][2]}', CASE s WHEN 'low' THEN 'no answer' ELSE 'no valid judgment in the output' END FROM u WHERE s IN ('low', 'info')
UNION ALL SELECT digest, '{fixed.GATE_RULES["disagreement"][0]}', '{fixed.GATE_RULES["disagreement"][1]}', '{fixed.GATE_RULES["disagreement"][2]}', 'rules=quarantine stub=allow' FROM u WHERE s = 'high'""")
def model_findings(spark, sf_dir):
    """A model's judgments of users, its failures and its disagreement with the rules."""
    e = read(spark, sf_dir, "events")
    digest = F.col("user_id").cast("string").alias("digest")
    found = e.select(digest, F.lit("static").alias("stage"), F.col("event_type").alias("rule"), F.expr(_KINDS).alias("severity"), F.col("event_type").alias("description"), F.lit("").alias("evidence"), F.col("event_id").alias("ord"))
    evidence = e.select(digest).distinct().select("digest", F.lit(None).cast("map<string,string>").alias("excerpts"), F.lit(None).cast("binary").alias("behavior_log"))
    told = cut(triage_findings(TextModel("stub", _opinion), evidence, found, policies(spark)))
    return told.select("digest", "rule", "severity", "description", "evidence")
