"""Queries of single functions, joins, windows, splits and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import fixed, paths
from palisade.functions import scalars as S
from palisade.functions.needles import first_found, found
from palisade.functions.regex import all_matches
from palisade.operators import behavior_rules
from palisade.operators.advisories import advisory_findings
from palisade.operators.static_rules import content_findings
from palisade.operators.triage import RuleModel
from palisade.operators.versions import append_history, file_changes, hook_changes, previous_good
from palisade.plans import splits
from palisade.sources import sinks, tables
from palisade.sources.scratch import shared_dir
from palisade.streaming import admission

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _re(pattern: str) -> str:
    """A fixed pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"SELECT doc_id, regexp_matches(text, {_re(fixed.GENERIC_SECRET)}) AS secret, regexp_matches(text, {_re(fixed.PRIVATE_KEY)}) AS private_key, regexp_extract(text, {_re(fixed.AWS_KEY)}) AS aws_key FROM documents")
def secret_scan(spark, sf_dir):
    t, low = F.col("text"), F.col("low")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    return docs.select("doc_id", found(t, low, fixed.GENERIC_SECRET).alias("secret"), found(t, low, fixed.PRIVATE_KEY).alias("private_key"), first_found(t, low, fixed.AWS_KEY).alias("aws_key"))


_PAD = "CASE doc_id % 5 WHEN 0 THEN 'é日本 eval(' || repeat('日', CAST(doc_id // 5 % 260 AS INT)) || ' atob(1)' WHEN 1 THEN 'ключ https://discord.com/api/webhooks/123456789012345678/' || repeat('ab', 20) || ' ü' WHEN 2 THEN 'ß rm -rf /home/ü' ELSE '' END"
_TEXT = f"text || chr(10) || {_PAD} || chr(10)"


@query(f"""WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents WHERE text IS NOT NULL),
r(rule, p, plain) AS (VALUES ('dynamic-exec-decoded', {_re(fixed.DYN_EXEC_DECODED)}, 0), ('hardcoded-webhook-exfil', {_re(fixed.WEBHOOK)}, 0), ('destructive-payload', {_re(fixed.DESTRUCTIVE)}, 1))
SELECT doc_id, rule, 'lib/x.js: ' || regexp_extract(t, p) AS evidence FROM d, r WHERE regexp_matches(t, p) AND (plain = 0 OR list_max([octet_length(encode(x)) FOR x IN string_split(t, chr(10))]) <= 2000)""")
def content_evidence(spark, sf_dir):
    """Every document is a package of one file, some with a line whose gap between call and decoder is of three-byte
    characters: evidence is what the pattern matched, bounds count characters."""
    pad = F.expr(_PAD.replace("//", "div"))
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").repartition("doc_id")
    files = docs.select(F.col("doc_id").cast("string").alias("digest"), F.lit("npm").alias("ecosystem"), F.lit(0).alias("file_idx"), F.lit("lib/x.js").alias("path"), F.concat("text", F.lit("\n"), pad, F.lit("\n")).cast("binary").alias("content"))
    found = content_findings(files, spark.createDataFrame([], "digest string, target string"))
    rules = ("dynamic-exec-decoded", "hardcoded-webhook-exfil", "destructive-payload")
    return found.filter(F.col("rule").isin(*rules)).select(F.col("digest").cast("long").alias("doc_id"), "rule", "evidence")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS n FROM documents WHERE regexp_matches(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')")
def ipv4_mentions(spark, sf_dir):
    n = F.size(all_matches(F.col("text"), r"\b(?:\d{1,3}\.){3}\d{1,3}\b"))
    return read(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n")).filter("n > 0")


@query("SELECT event_id, 'sha' || substr(md5(CAST(event_id AS VARCHAR)), 1, event_id % 30 + 10) || CASE WHEN event_id % 3 = 0 THEN '=' ELSE '' END AS word, len(regexp_extract_all('''' || 'sha' || substr(md5(CAST(event_id AS VARCHAR)), 1, event_id % 30 + 10) || CASE WHEN event_id % 3 = 0 THEN '=' ELSE '' END || '''', " + _re(fixed.B64_LITERAL) + ")) AS n FROM events")
def b64_literals(spark, sf_dir):
    word = F.expr("concat('sha', substr(md5(cast(event_id as string)), 1, cast(event_id % 30 + 10 as int)), if(event_id % 3 = 0, '=', ''))")
    return read(spark, sf_dir, "events").select("event_id", word.alias("word")).withColumn("n", F.size(all_matches(F.concat(F.lit("'"), F.col("word"), F.lit("'")), fixed.B64_LITERAL, 1)).cast("long"))


@query("SELECT doc_id, CAST(list_max([octet_length(encode(x)) FOR x IN string_split(text, chr(10))]) AS BIGINT) AS longest, list_max([octet_length(encode(x)) FOR x IN string_split(text, chr(10))]) > 2000 AS minified FROM documents")
def max_line_length(spark, sf_dir):
    longest = S.max_line_length(F.col("text")).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", longest.alias("longest"), S.is_minified(F.col("text").cast("binary")).alias("minified"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest, true AS sound FROM documents")
def content_digest(spark, sf_dir):
    d = S.digest(F.col("text").cast("binary"))
    return read(spark, sf_dir, "documents").select("doc_id", d.alias("digest"), S.is_digest(d).alias("sound"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_digest(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS hash, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS nth FROM documents")
def md5_order(spark, sf_dir):
    from pyspark.sql import Window

    hash_ = F.md5(F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", hash_.alias("hash"), F.row_number().over(Window.partitionBy("lang").orderBy(hash_)).cast("long").alias("nth"))


_HOST = r"regexp_extract(url, '(?i)https?://([A-Za-z0-9._\-]+)', 1)"


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), s AS (SELECT *, string_split(host, '.') AS p FROM h)
SELECT page_id, host, CASE WHEN len(p) <= 2 THEN host ELSE p[-2] || '.' || p[-1] END AS parent FROM s""")
def url_host(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"(?i)https?://([A-Za-z0-9._\-]+)", 1).alias("host")).withColumn("parent", S.parent_domain(F.col("host")))


_BENT = f"(SELECT page_id, CASE page_id % 9 WHEN 0 THEN {_HOST} || '.oast.fun' WHEN 1 THEN 'cdn.github.com.' WHEN 2 THEN 'Registry.npmjs.org' WHEN 3 THEN 'evilnpmjs.org' WHEN 4 THEN 'localhost' WHEN 5 THEN 'printer.local' WHEN 6 THEN 'files.pythonhosted.org' WHEN 7 THEN 'ngrok.io' ELSE {_HOST} END AS host FROM pages)"


@query(f"""WITH b AS (SELECT page_id, host, regexp_replace(lower(host), '\\.$', '') AS h FROM {_BENT}),
allowed AS (SELECT unnest([{", ".join(repr(x) for x in fixed.INSTALL_FETCH_ALLOWED)}]) AS s), tunnel AS (SELECT unnest([{", ".join(repr(x) for x in fixed.EPHEMERAL_TUNNELS)}]) AS s),
known AS (SELECT unnest([{", ".join(repr(x) for x in fixed.REGISTRY_HOSTS["npm"])}]) AS s)
SELECT page_id, host, EXISTS (SELECT 1 FROM allowed WHERE h = s OR ends_with(h, '.' || s)) AS allowed, EXISTS (SELECT 1 FROM tunnel WHERE lower(host) = s OR ends_with(lower(host), '.' || s)) AS tunnel,
       NOT (h IN ('', 'localhost') OR ends_with(h, '.local') OR EXISTS (SELECT 1 FROM known WHERE h = ltrim(s, '.') OR ends_with(h, s))) AS is_unknown FROM b""")
def host_allowlist(spark, sf_dir):
    got = F.regexp_extract("url", r"(?i)https?://([A-Za-z0-9._\-]+)", 1)
    bent = F.expr("page_id % 9")
    host = F.when(bent == 0, F.concat(got, F.lit(".oast.fun")))
    for k, name in enumerate(["cdn.github.com.", "Registry.npmjs.org", "evilnpmjs.org", "localhost", "printer.local", "files.pythonhosted.org", "ngrok.io"], 1):
        host = host.when(bent == k, name)
    rows = read(spark, sf_dir, "pages").select("page_id", host.otherwise(got).alias("host"))
    h = F.col("host")
    return rows.select("page_id", "host", S.install_fetch_allowed(h).alias("allowed"), S.is_ephemeral_tunnel(h).alias("tunnel"), S.is_unknown_domain(F.lit("npm"), h).alias("is_unknown"))


@query(f"""WITH s AS (SELECT string_split({_HOST}, '.') AS p FROM pages) SELECT p[-2] || '.' || p[-1] AS parent, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, parent LIMIT 5""")
def parent_domain_topk(spark, sf_dir):
    hosts = url_host(spark, sf_dir)
    return hosts.groupBy("parent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent").limit(5)


_IP = "(event_id * 7919 % 256)"


@query(f"""WITH a AS (SELECT event_id, {_IP} AS a, event_id * 104729 % 256 AS b, event_id * 31 % 256 AS c, event_id * 17 % 300 AS d FROM events UNION ALL SELECT -k, a, b, c, d FROM (VALUES (1,8,8,8,8),(2,1,2,3,4),(3,9,9,9,9),(4,203,0,113,7),(5,172,20,0,1),(6,100,70,1,1),(7,198,51,100,3),(8,192,0,2,1)) v(k,a,b,c,d))
SELECT event_id, concat_ws('.', a, b, c, d) AS address,
  greatest(a,b,c,d) <= 255 AND NOT (a IN (0,10,127) OR a >= 224 OR (a=b AND b=c AND c=d) OR (a=172 AND b BETWEEN 16 AND 31) OR (a=192 AND b=168) OR (a=169 AND b=254) OR (a=100 AND b BETWEEN 64 AND 127) OR (a=192 AND b=0 AND c=2) OR (a=198 AND b=51 AND c=100) OR (a=203 AND b=0 AND c=113) OR (a=8 AND b=8 AND c IN (4,8)) OR (a=1 AND b=1 AND c=1 AND d=1) OR (a=1 AND b=2 AND c=3 AND d=4)) AS in_source,
  greatest(a,b,c,d) <= 255 AND NOT (a IN (10,127) OR a >= 224 OR (a=172 AND b BETWEEN 16 AND 31) OR (a=192 AND b=168) OR (a=169 AND b=254) OR (a=100 AND b BETWEEN 64 AND 127) OR (a=192 AND b=0 AND c=2) OR (a=198 AND b=51 AND c=100) OR (a=203 AND b=0 AND c=113) OR (a+b+c+d=0) OR concat_ws('.', a, b, c, d) IN {_in(fixed.PUBLIC_RESOLVERS)}) AS routable FROM a""")
def public_addresses(spark, sf_dir):
    octets = F.expr("array(event_id * 7919 % 256, event_id * 104729 % 256, event_id * 31 % 256, event_id * 17 % 300)")
    own = read(spark, sf_dir, "events").select("event_id", F.array_join(octets.cast("array<string>"), ".").alias("address"))
    odd = spark.createDataFrame([(-1, "8.8.8.8"), (-2, "1.2.3.4"), (-3, "9.9.9.9"), (-4, "203.0.113.7"), (-5, "172.20.0.1"), (-6, "100.70.1.1"), (-7, "198.51.100.3"), (-8, "192.0.2.1")], "event_id long, address string")
    a = F.col("address")
    return own.unionByName(odd).select("event_id", "address", S.is_public_ip(a).alias("in_source"), S.is_routable_public_ip(a).alias("routable"))


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an entry of its user's trace; its day is the phase."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    e = read(spark, sf_dir, "events").withColumns({"digest": F.col("user_id").cast("string"), "ecosystem": F.lit("npm"), "phase": day.cast("string"), "phase_ord": day, "pos": F.col("event_id")})
    return e.withColumns({"strong": F.col("value") > 150, "hostnames": F.array().cast("array<string>")})


_BURST = fixed.TRACE_RULES["recon"]
_DELETES = fixed.TRACE_RULES["deletes"]


@query(f"""SELECT CAST(user_id AS VARCHAR) AS digest, '{_BURST[0]}' AS rule, replace('{_BURST[2]}', '{{}}', CAST(count(DISTINCT event_type) AS VARCHAR)) AS description
FROM events WHERE value > 150 AND event_type <> 'view' GROUP BY user_id HAVING count(DISTINCT event_type) >= {fixed.RECON_TOOLS}""")
def recon_burst(spark, sf_dir):
    """Every event is a command; strong ones of four kinds are host profiling."""
    command = F.expr("CASE WHEN strong AND event_type = 'click' THEN array('uname', '-a') WHEN strong AND event_type = 'error' THEN array('sh', '-c', 'whoami x') WHEN strong AND event_type = 'purchase' THEN array('lscpu') WHEN strong AND event_type = 'signup' THEN array('/usr/bin/x', 'ip addr') ELSE array('ls', '-l') END")
    return behavior_rules.recon_burst(_acts(spark, sf_dir).withColumn("command", command)).select("digest", "rule", "description")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS digest, replace('{_DELETES[2]}', '{{}}', CAST(count(*) AS VARCHAR)) AS description, list_aggregate(list_transform(list_sort(list(struct_pack(d := CAST(ts AS DATE), e := event_id)))[:3], lambda x: '/home/u/' || x.e), 'string_agg', ', ') AS evidence
FROM events WHERE value > 60 GROUP BY user_id HAVING count(*) >= {fixed.DESTRUCTION_DELETES}""")
def mass_delete_threshold(spark, sf_dir):
    """Every event is a file entry; weak ones are deletes in the package manager's own trees."""
    path = F.concat(F.expr("if(value > 60, '/home/u/', '/x/node_modules/')"), F.col("event_id"))
    return behavior_rules.destruction(_acts(spark, sf_dir).withColumns({"path": path, "delete": F.lit(True)})).select("digest", "description", "evidence")


@query("SELECT CAST(user_id AS VARCHAR) AS digest FROM events GROUP BY user_id HAVING bool_or(event_type = 'view' AND value > 150) AND bool_or(event_type = 'error' AND value > 150)")
def exfil_chain(spark, sf_dir):
    """Every event reads a file and opens a socket; strong views read a secret, strong errors reach a public address,
    half of them told as IPv6."""
    e = _acts(spark, sf_dir)
    files = e.withColumns({"path": F.expr("if(strong AND event_type = 'view', '/root/.aws/credentials', '/srv/x')"), "read": F.lit(True)})
    address = F.expr("if(strong AND event_type = 'error', if(event_id % 2 = 0, '45.77.13.9', '::ffff:45.77.13.9'), '10.0.0.1')")
    return behavior_rules.exfil_chain(files, e.withColumn("address", address), e.withColumn("host", F.lit("localhost"))).select("digest")


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) - DATE '2024-01-01' AS day, '/tmp/' || md5(props) || '.sh' AS path FROM events)
SELECT CAST(c.user_id AS VARCHAR) AS digest, c.event_id AS pos, c.path AS evidence, 'executes a file it dropped during ' || c.day AS description FROM e c
WHERE c.event_type = 'purchase' AND EXISTS (SELECT 1 FROM e d WHERE d.event_type = 'click' AND d.user_id = c.user_id AND d.path = c.path AND d.day <= c.day)""")
def drop_and_execute(spark, sf_dir):
    """Clicks drop a file, purchases run one, all others look at one."""
    e = _acts(spark, sf_dir).withColumn("path", F.concat(F.lit("/tmp/"), F.md5("props"), F.lit(".sh"))).withColumn("write", F.col("event_type") == "click")
    commands = e.withColumn("command", F.when(F.col("event_type") == "purchase", F.array(F.lit("sh"), F.col("path"))).otherwise(F.array(F.lit("ls"), F.lit("-l"))))
    found = behavior_rules.drop_and_execute(e, commands)
    return found.select("digest", F.expr(f"ord % {behavior_rules.PER_KIND}").alias("pos"), "evidence", "description")


@query("""WITH h AS (SELECT user_id, event_id, event_type, value > 20 AS ok FROM events)
SELECT c.event_id, max(p.event_id) AS previous FROM h c JOIN h p ON p.user_id = c.user_id AND p.event_id < c.event_id AND p.ok AND p.event_type <> c.event_type GROUP BY c.event_id""")
def previous_good_version(spark, sf_dir):
    """As-of: the latest earlier entry of the same package that was allowed and has another digest (here: kind)."""
    e = read(spark, sf_dir, "events").select(F.lit("npm").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.col("event_id").cast("string").alias("version"), F.col("event_type").alias("digest"), F.when(F.col("value") > 20, "allow").otherwise("block").alias("decision"), F.col("event_id").alias("seq"))
    out = previous_good(e.withColumn("asked", F.col("seq")), e, carry="asked")
    return out.select(F.col("asked").alias("event_id"), F.col("prev_version").cast("long").alias("previous"))


@query("""WITH f AS (SELECT source, lang || '/' || doc_id // 40 AS path, arg_max(sha256(text), doc_id) AS hash FROM documents WHERE source IS NOT NULL GROUP BY 1, 2),
s AS (SELECT source, lag(source) OVER (ORDER BY length(source), source) AS before FROM (SELECT DISTINCT source FROM f)),
sides AS (SELECT s.source AS digest, path, hash AS now, NULL AS old FROM s JOIN f USING (source) WHERE before IS NOT NULL UNION ALL SELECT s.source, path, NULL, hash FROM s JOIN f ON f.source = before),
both_sides AS (SELECT digest, path, max(now) AS now, max(old) AS old FROM sides GROUP BY ALL)
SELECT digest, path, CASE WHEN old IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'modified' END AS change FROM both_sides WHERE now IS DISTINCT FROM old""")
def version_diff(spark, sf_dir):
    """Each source against the one before it."""
    from pyspark.sql import Window

    d = read(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("digest"), F.concat("lang", F.lit("/"), F.expr("cast(doc_id div 40 as string)")).alias("path"), F.col("text").cast("binary").alias("content"), F.col("doc_id").cast("int").alias("file_idx"))
    # src2 comes before src10; one row a source
    in_order = Window.orderBy(F.length("source"), "source")
    sources = d.select("source").distinct().filter("source IS NOT NULL")
    pairs = sources.select(F.col("source").alias("digest"), F.lag("source").over(in_order).alias("prev_digest")).filter("prev_digest IS NOT NULL")
    return file_changes(pairs, files).select("digest", "path", "change")


@query(f"""WITH h AS (SELECT conv_id, CASE role WHEN 'user' THEN 'preinstall' WHEN 'assistant' THEN 'install' ELSE 'postinstall' END AS hook, turn // 2 AS v, max_by(coalesce(text, ''), turn) AS command FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
v AS (SELECT DISTINCT conv_id, v FROM h)
SELECT c.conv_id || '-' || c.v AS digest, CASE WHEN p.command IS NULL THEN '{fixed.DIFF_RULES["hook-added"][0]}' ELSE '{fixed.DIFF_RULES["hook-changed"][0]}' END AS rule, replace(CASE WHEN p.command IS NULL THEN '{fixed.DIFF_RULES["hook-added"][2].replace("'", "''")}' ELSE '{fixed.DIFF_RULES["hook-changed"][2].replace("'", "''")}' END, '{{}}', c.hook) AS description
FROM h c JOIN v ON v.conv_id = c.conv_id AND v.v = c.v - 1 LEFT JOIN h p ON p.conv_id = c.conv_id AND p.hook = c.hook AND p.v = c.v - 1 WHERE p.command IS DISTINCT FROM c.command""")
def hook_diff(spark, sf_dir):
    """Two turns of a conversation are a version, whose install hooks they are."""
    hook = F.expr("CASE role WHEN 'user' THEN 'preinstall' WHEN 'assistant' THEN 'install' ELSE 'postinstall' END")
    turns = read(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").select("conv_id", F.expr("turn div 2").alias("v"), hook.alias("hook"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    hooks = turns.groupBy("conv_id", "v", "hook").agg(F.max_by("text", "turn").alias("command")).groupBy("conv_id", "v").agg(F.map_from_entries(F.collect_list(F.struct("hook", "command"))).alias("scripts"))
    name = F.concat_ws("-", "conv_id", "v")
    files = hooks.select(name.alias("digest"), F.lit("npm").alias("ecosystem"), F.lit(0).alias("file_idx"), F.lit("package.json").alias("path"), F.to_json(F.struct("scripts")).cast("binary").alias("content"))
    versions = hooks.select("conv_id", "v")
    pairs = versions.join(versions.select("conv_id", (F.col("v") + 1).alias("v")), ["conv_id", "v"]).select(name.alias("digest"), F.concat_ws("-", "conv_id", F.col("v") - 1).alias("prev_digest"))
    return hook_changes(pairs, files).select("digest", "rule", "description")


@query("""SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS digest, 'P-' || p_partkey AS rule,
CASE upper(p_type) WHEN 'ECONOMY' THEN 'low' WHEN 'STANDARD' THEN 'medium' WHEN 'PROMO' THEN 'critical' ELSE CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'medium' END END AS severity, 'known vulnerability P-' || p_partkey || ': ' || p_name AS description, 'P-' || p_partkey AS evidence
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def vuln_lookup(spark, sf_dir):
    """Every part is an advisory."""
    label = F.expr("CASE upper(p_type) WHEN 'ECONOMY' THEN 'LOW' WHEN 'STANDARD' THEN 'Moderate' WHEN 'PROMO' THEN 'CRITICAL' END")
    scores = F.when(F.expr("p_size % 2 = 0"), F.array(F.struct(F.lit("cvss_v3").alias("type"), F.lit("x").alias("score"))))
    part = read(spark, sf_dir, "part")
    advisories = part.select(F.lit("PyPI").alias("ecosystem"), F.col("p_partkey").cast("string").alias("name"), F.lit("1").alias("version"), F.concat(F.lit("P-"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("summary"), label.alias("db_severity"), scores.alias("severity"))
    artifacts = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("digest"), F.lit("pypi").alias("ecosystem"), F.col("l_partkey").cast("string").alias("name"), F.lit("1").alias("version"))
    return advisory_findings(artifacts, advisories).select("digest", "rule", "severity", "description", "evidence")


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def first_file_wins(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("lang", "doc_id").alias("lang"))


@query("SELECT o_custkey, o_orderkey, CAST(nth AS BIGINT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 3")
def signal_topk(spark, sf_dir):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, sf_dir, "orders").withColumn("nth", nth.cast("long")).filter("nth <= 3").select("o_custkey", "o_orderkey", "nth")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages: named by customer and priority, first seen on the order's date."""
    name = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN concat('fam-', cast(o_custkey % 40 as string), '-', cast(o_orderkey as string)) ELSE concat('pkg', cast(o_orderkey as string)) END")
    return read(spark, sf_dir, "orders").select(F.expr("if(o_orderkey % 2 = 0, 'npm', 'pypi')").alias("ecosystem"), name.alias("name"), F.to_date("o_orderdate").alias("first_seen"))


_POOL = "pool AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE WHEN o_orderkey % 7 = 0 THEN 'fam-' || o_custkey % 40 || '-' || o_orderkey ELSE 'pkg' || o_orderkey END AS name, CAST(o_orderdate AS DATE) AS first_seen FROM orders)"
_DAYS = "days AS (SELECT ecosystem, first_seen FROM pool GROUP BY ALL HAVING count(*) >= 4)"
_FAMILIES = "families AS (SELECT ecosystem, split_part(name, '-', 1) || '-' || split_part(name, '-', 2) AS family FROM pool WHERE len(string_split(name, '-')) > 2 GROUP BY ALL HAVING count(*) >= 3)"
_CAMPAIGNS = f"""RECURSIVE {_POOL}, {_DAYS}, {_FAMILIES},
keyed AS (SELECT p.*, CASE WHEN d.first_seen IS NOT NULL THEN 'd' || p.first_seen END AS a, CASE WHEN f.family IS NOT NULL THEN 'f' || f.family END AS b FROM pool p LEFT JOIN days d USING (ecosystem, first_seen)
          LEFT JOIN families f ON f.ecosystem = p.ecosystem AND len(string_split(p.name, '-')) > 2 AND f.family = split_part(p.name, '-', 1) || '-' || split_part(p.name, '-', 2)),
edges AS (SELECT DISTINCT ecosystem, a AS x, b AS y FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL),
both_ways AS (SELECT * FROM edges UNION SELECT ecosystem, y, x FROM edges),
reach AS (SELECT ecosystem, g AS x, g AS r FROM (SELECT ecosystem, a AS g FROM keyed WHERE a IS NOT NULL UNION SELECT ecosystem, b FROM keyed WHERE b IS NOT NULL)
          UNION SELECT r.ecosystem, r.x, e.y FROM reach r JOIN both_ways e ON e.ecosystem = r.ecosystem AND e.x = r.r),
groups AS (SELECT ecosystem, x, min(r) AS root FROM reach GROUP BY ALL),
rooted AS (SELECT k.ecosystem, k.name, k.first_seen, coalesce(g.root, 'n' || k.name) AS root FROM keyed k LEFT JOIN groups g ON g.ecosystem = k.ecosystem AND g.x = coalesce(k.a, k.b)),
campaigns AS (SELECT ecosystem, name, first_seen, min(name) OVER (PARTITION BY ecosystem, root) AS campaign_id FROM rooted)"""


def _dated(rows: DataFrame) -> DataFrame:
    """Dates as text, which both engines compare alike."""
    return rows.withColumn("first_seen", F.col("first_seen").cast("string"))


def _clusters(spark, sf_dir):
    return splits.campaigns(_pool(spark, sf_dir), bulk=4)


@query(f"WITH {_POOL} SELECT ecosystem, CAST(first_seen AS VARCHAR) AS first_seen, count(*) AS n, min(name) AS head FROM pool GROUP BY ALL HAVING count(*) >= 4")
def bulk_days(spark, sf_dir):
    return _dated(splits.bulk_days(_pool(spark, sf_dir), 4))


@query(f"WITH {_POOL} SELECT ecosystem, split_part(name, '-', 1) || '-' || split_part(name, '-', 2) AS prefix, count(*) AS n, min(name) AS head FROM pool WHERE len(string_split(name, '-')) > 2 GROUP BY 1, 2 HAVING count(*) >= 3")
def prefix_groups(spark, sf_dir):
    return splits.prefix_groups(_pool(spark, sf_dir))


@query(f"WITH {_CAMPAIGNS} SELECT ecosystem, name, campaign_id FROM campaigns")
def campaign_components(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"WITH {_CAMPAIGNS}, s AS (SELECT ecosystem, campaign_id, count(*) AS n FROM campaigns GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS packages, count(*) AS campaigns, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_multi, count(*) FILTER (n > 1) AS multi FROM s")
def campaign_stats(spark, sf_dir):
    return splits.campaign_stats(_clusters(spark, sf_dir))


@query(f"WITH {_CAMPAIGNS} SELECT ecosystem, campaign_id, count(*) AS n FROM campaigns GROUP BY ALL ORDER BY n DESC, ecosystem, campaign_id LIMIT 5")
def largest_campaigns(spark, sf_dir):
    return splits.largest_campaigns(_clusters(spark, sf_dir))


@query(f"WITH {_POOL} SELECT strftime(first_seen, '%Y') AS year, count(*) AS n FROM pool GROUP BY 1")
def pool_years(spark, sf_dir):
    return splits.years(_pool(spark, sf_dir))


@query(f"""WITH {_CAMPAIGNS}, early AS (SELECT DISTINCT ecosystem, campaign_id FROM campaigns WHERE first_seen < DATE '1999-01-01')
SELECT c.ecosystem, c.name, CAST(c.first_seen AS VARCHAR) AS first_seen, c.campaign_id, CASE WHEN first_seen >= DATE '1999-01-01' AND e.campaign_id IS NULL THEN 'test' ELSE 'train' END AS side, first_seen >= DATE '1999-01-01' AND e.campaign_id IS NOT NULL AS moved FROM campaigns c LEFT JOIN early e USING (ecosystem, campaign_id)""")
def temporal_split(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return _dated(splits.temporal_split(pool, _clusters(spark, sf_dir), "1999-01-01"))


@query(f"""WITH {_CAMPAIGNS} SELECT ecosystem, campaign_id FROM campaigns GROUP BY ALL HAVING bool_or(first_seen >= DATE '1999-01-01') AND bool_or(first_seen < DATE '1999-01-01')""")
def split_leaks(spark, sf_dir):
    """What a split by date alone would leak: campaigns on both sides."""
    side = F.when(F.col("first_seen") >= F.lit("1999-01-01").cast("date"), "test").otherwise("train")
    both = _pool(spark, sf_dir).join(_clusters(spark, sf_dir), ["ecosystem", "name"])
    return splits.leaks(both.withColumn("side", side)).select("ecosystem", "campaign_id")


@query(f"""WITH {_CAMPAIGNS}, g AS (SELECT ecosystem, campaign_id, md5(ecosystem || '/' || campaign_id) AS hash, count(*) AS n FROM campaigns GROUP BY ALL),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY ecosystem ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT c.ecosystem, c.name, CAST(c.first_seen AS VARCHAR) AS first_seen, c.campaign_id FROM campaigns c JOIN o USING (ecosystem, campaign_id) WHERE before >= CASE c.ecosystem WHEN 'npm' THEN 120 ELSE 30 END AND before < 2 * CASE c.ecosystem WHEN 'npm' THEN 120 ELSE 30 END""")
def campaign_slice(spark, sf_dir):
    return _dated(splits.campaign_slice(_pool(spark, sf_dir), _clusters(spark, sf_dir), 2))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT DISTINCT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf_dir):
    known = read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("name"))
    return tables.unlisted(read(spark, sf_dir, "nation"), known, "n_nationkey").select(F.col("n_nationkey").alias("nation"))


@query("SELECT n_name AS name FROM nation SEMI JOIN supplier ON s_nationkey = n_nationkey")
def name_semi_join(spark, sf_dir):
    known = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"))
    return tables.listed(read(spark, sf_dir, "nation"), known, "n_nationkey").select(F.col("n_name").alias("name"))


@query("""SELECT CAST(user_id AS VARCHAR) AS name, event_type AS digest, min(event_id) AS seq FROM events GROUP BY ALL""")
def history_dedupe(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.lit("npm").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("digest"), F.col("event_id").alias("seq"))
    return append_history(e.limit(0), e).select("name", "digest", "seq")


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table in the shared folder, and read it."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/palisade-{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query("SELECT DISTINCT event_type AS digest FROM events")
def stream_judge_once(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("digest"))
    return _drained(admission.judged_once(rows), "once")


@query("""WITH f AS (SELECT user_id, event_type, min(struct_pack(ts := ts, t := event_type)) AS m FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS name, event_type AS digest, m.ts AS seen_at, row_number() OVER (PARTITION BY user_id ORDER BY m) - 1 AS seq FROM f""")
def stream_history(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.lit("npm").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.col("event_id").cast("string").alias("version"), F.col("event_type").alias("digest"), F.lit("allow").alias("decision"), F.col("ts").cast("timestamp").alias("seen_at"))
    return _drained(admission.history(rows), "history").select("name", "digest", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "seq")


@query("""WITH m AS (SELECT user_id, max(CASE event_type WHEN 'error' THEN CASE WHEN value > 200 THEN 4 ELSE 0 END WHEN 'purchase' THEN CASE WHEN value > 200 THEN 3 ELSE 1 END ELSE 0 END) AS worst, bool_or(event_id % 500 = 3) AS marked FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS digest, CASE greatest(worst, CASE WHEN marked THEN 3 ELSE 0 END) WHEN 4 THEN 'block' WHEN 3 THEN 'quarantine' ELSE 'allow' END AS decision, CASE greatest(worst, CASE WHEN marked THEN 3 ELSE 0 END) WHEN 4 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM m""")
def mock_triage(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    severity = F.expr("CASE event_type WHEN 'error' THEN if(value > 200, 'critical', 'info') WHEN 'purchase' THEN if(value > 200, 'high', 'low') ELSE 'info' END")
    found = e.select(F.col("user_id").cast("string").alias("digest"), severity.alias("severity"), F.col("event_type").alias("description"), F.col("event_id").alias("ord"))
    evidence = e.groupBy(F.col("user_id").cast("string").alias("digest")).agg(F.max(F.when(F.expr("event_id % 500 = 3"), F.lit("opens /etc/passwd").cast("binary"))).alias("behavior_log"))
    return RuleModel().judge(evidence, found).select("digest", "decision", "confidence")


@query("""WITH p AS (SELECT unnest(['tests/a.js', 'src/latest.js', 'docs', 'a/spec/b.ts', 'lib/data/x.py', 'README.md', 'src/a_test.go', 'dist/app.js', 'a/dist/b.js', 'src/app.min.js', 'Makefile', 'x/tools/y.sh', 'conf/a.YAML', 'setup.py', 'a/Setup.cfg', 'a.dist-info/METADATA', 'PKG-INFO', 'x/sboms/a.json', 'a.spdx.json', 'src/index.js']) AS path)
SELECT path, path IN ('tests/a.js', 'docs', 'a/spec/b.ts', 'lib/data/x.py', 'README.md', 'src/a_test.go') AS test_doc, path IN ('conf/a.YAML', 'a/Setup.cfg', 'x/sboms/a.json', 'a.spdx.json') AS data_config, path IN ('dist/app.js', 'a/dist/b.js', 'src/app.min.js') AS bundle,
       path IN ('Makefile', 'x/tools/y.sh') AS build, path IN ('setup.py', 'a/Setup.cfg') AS setup, path IN ('a.dist-info/METADATA', 'PKG-INFO') AS metadata, path IN ('x/sboms/a.json', 'a.spdx.json') AS sbom FROM p""")
def path_kinds(spark, sf_dir):
    names = ["tests/a.js", "src/latest.js", "docs", "a/spec/b.ts", "lib/data/x.py", "README.md", "src/a_test.go", "dist/app.js", "a/dist/b.js", "src/app.min.js", "Makefile", "x/tools/y.sh", "conf/a.YAML", "setup.py", "a/Setup.cfg", "a.dist-info/METADATA", "PKG-INFO", "x/sboms/a.json", "a.spdx.json", "src/index.js"]
    p = F.col("path")
    kinds = {"test_doc": paths.is_test_or_doc, "data_config": paths.is_data_config, "bundle": paths.is_vendored_bundle, "build": paths.is_build_tooling, "setup": paths.is_setup_file, "metadata": paths.is_package_metadata, "sbom": paths.is_sbom}
    return spark.createDataFrame([(n,) for n in names], "path string").select("path", *[f(p).alias(k) for k, f in kinds.items()])


@query("""SELECT 'pkg-' || p_partkey || '-1.' || p_size || '.tgz' AS file, '1.' || p_size AS npm, 'my_' || p_partkey AS wheel_name, '2.' || p_size AS wheel_version, 'a-' || p_partkey AS sdist_name, '3.' || p_size AS sdist_version FROM part""")
def file_names(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("@scope/pkg-"), F.col("p_partkey")).alias("n"), F.expr("concat('pkg-', p_partkey, '-1.', p_size, '.tgz')").alias("file"), F.expr("concat('my_', p_partkey, '-2.', p_size, '-py3-none-any.whl')").alias("w"), F.expr("concat('a-', p_partkey, '-3.', p_size, '.tar.gz')").alias("s"))
    w, s = S.pypi_name_version(F.col("w")), S.pypi_name_version(F.col("s"))
    return rows.select("file", S.npm_version_from_tarball(F.col("n"), F.col("file")).alias("npm"), w["name"].alias("wheel_name"), w["version"].alias("wheel_version"), s["name"].alias("sdist_name"), s["version"].alias("sdist_version"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS path, CASE WHEN o.o_custkey % 3 > 0 THEN 'd' || o_custkey % 50 END AS digest, CASE WHEN o.o_custkey % 3 > 0 AND o_custkey % 50 < 40 THEN CASE WHEN o_custkey % 50 < 30 THEN 'allow' ELSE 'block' END END AS decision, CASE WHEN o.o_custkey % 3 > 0 AND o_custkey % 50 < 20 THEN 'bytes' END AS content FROM (SELECT DISTINCT o_custkey FROM orders) o""")
def lookup_chain(spark, sf_dir):
    keys = read(spark, sf_dir, "orders").select("o_custkey").distinct()
    locators = keys.filter("o_custkey % 3 > 0").select(F.col("o_custkey").cast("string").alias("path"), F.expr("concat('d', o_custkey % 50)").alias("digest"))
    n = spark.range(50)
    verdicts = n.filter("id < 40").select(F.concat(F.lit("d"), F.col("id")).alias("digest"), F.when(F.col("id") < 30, "allow").otherwise("block").alias("decision"))
    stored = n.filter("id < 20").select(F.concat(F.lit("d"), F.col("id")).alias("digest"), F.lit("bytes").alias("content"))
    return sinks.lookup_chain(keys.select(F.col("o_custkey").cast("string").alias("path")), locators, verdicts, stored)


@query("""SELECT event_id, '1700000000.' || event_id % 10 AS at, '10.0.0.' || event_id % 250 AS src, 'host' || event_id || '.example' AS sni, event_type AS decrypted FROM events WHERE event_type <> 'view'""")
def sink_log_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select("event_id", F.expr("concat('1700000000.', event_id % 10, ' src=10.0.0.', event_id % 250, ' orig_dst=1.2.3.4:443 ', if(event_type = 'view', 'plaintext=x', concat('TLS sni=host', event_id, '.example DECRYPTED=', event_type)))").alias("value"))
    parsed = tables.sink_log(lines).filter("tls")
    return parsed.select(F.regexp_extract("sni", r"host(\d+)", 1).cast("long").alias("event_id"), F.format_string("%.1f", "at").alias("at"), "src", "sni", "decrypted")
