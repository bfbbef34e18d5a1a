"""Findings from the contents of packages.

files: digest, ecosystem, file_idx, path, content. Findings: digest, stage, rule, severity, description, evidence, ord.
Every rule is a column over one scan of the files, and contents are never shuffled: what depends on the artifact's
hooks is found as a candidate and settled on the slim rows of what was found, as is a family's first file in archive
order, which alone reports. An artifact's findings are bounded by its files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import scalars as S
from palisade.functions.needles import first_found, found
from palisade.functions.paths import base_name, is_build_tooling, is_data_config, is_package_metadata, is_sbom, is_setup_file, is_test_or_doc, is_vendored_bundle
from palisade.functions.regex import all_matches, first_match, matches

FINDING = "digest string, stage string, rule string, severity string, description string, evidence string, ord long"
#: Findings of hooks and setup scripts come before those of files.
EARLY, PER_FILE = -1000, 100


def lookup(files: DataFrame, *paths: str) -> DataFrame:
    """digest, path, content of exact paths; of duplicates the last in the archive."""
    return files.filter(F.col("path").isin(*paths)).groupBy("digest", "path").agg(F.max_by("content", "file_idx").alias("content"))


def npm_hooks(files: DataFrame) -> DataFrame:
    """digest, hook, command of install hooks. A script that is no string voids the whole package.json."""
    scripts = F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$.scripts", "map<string,variant>")
    found = lookup(files.filter("ecosystem = 'npm'"), "package.json").select("digest", scripts.alias("scripts")).filter("scripts IS NOT NULL")
    sound = F.forall(F.map_values("scripts"), lambda v: v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID"))
    hooks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(h).alias("hook")) for n, h in enumerate(fixed.INSTALL_HOOKS)])
    named = found.filter(sound).select("digest", "scripts", F.explode(hooks).alias("h")).filter(F.map_contains_key("scripts", F.col("h.hook")))
    return named.select("digest", F.col("h.n").alias("n"), F.col("h.hook").alias("hook"), F.coalesce(F.try_variant_get(F.col("scripts")[F.col("h.hook")], "$", "string"), F.lit("")).alias("command"))


def hook_targets(hooks: DataFrame) -> DataFrame:
    """digest, target: base names of the scripts that hooks run."""
    return hooks.select("digest", F.explode(F.transform(all_matches(F.col("command"), fixed.SCRIPT_FILE), base_name)).alias("target"))


#: Gates of a candidate: it counts always, only in files that a hook runs, only in others.
ALWAYS, IN_HOOKS, ELSEWHERE = 0, 1, -1


def finding(key: str, evidence: Column, n: int, family: str = "", name: Column | None = None, gate: int = ALWAYS) -> Column:
    """A struct of the rule's fixed values. n: order among the rules of one file."""
    rule, severity, description = fixed.CONTENT_RULES[key]
    told = F.lit(description) if name is None else F.format_string(description.replace("{}", "%s"), name)
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), told.alias("description"), evidence.alias("evidence"), F.lit(n).alias("n"), F.lit(family or rule).alias("family"), F.lit(gate).alias("gate"))


def hook_findings(hooks: DataFrame) -> DataFrame:
    """One finding for each hook; the worst kind that its command shows."""
    c = F.col("command")
    say = lambda key: finding(key, S.truncate(c, 200), 0, name=F.col("hook"))
    verdict = F.when(matches(c, fixed.DESTRUCTIVE), say("hook-destructive")).when(matches(c, fixed.DANGER), say("hook-danger")).when(matches(c, fixed.URL_OR_IP), say("hook-network")).otherwise(say("hook"))
    return hooks.select("digest", verdict.alias("v"), (F.lit(EARLY) + F.col("n")).cast("long").alias("ord")).select("digest", F.lit("static").alias("stage"), "v.rule", "v.severity", "v.description", "v.evidence", "ord")


def setup_findings(files: DataFrame) -> DataFrame:
    """Root setup scripts that destroy, or reach out while they install. Long literals don't count as code."""
    found = lookup(files.filter("ecosystem = 'pypi'"), *fixed.SETUP_NAMES)
    code = found.select("digest", "path", S.strip_long_literals(S.as_text(F.col("content"))).alias("code"))
    c, name = F.col("code"), F.col("path")
    net, danger = first_match(c, fixed.PY_NET_CALL), first_match(c, fixed.DANGER)
    kinds = F.array(
        F.when(matches(c, fixed.DESTRUCTIVE), finding("setup-destructive", first_match(c, fixed.DESTRUCTIVE), 0, name=name)),
        F.when((net != "") | (danger != "") | matches(c, fixed.DYN_EXEC_DECODED), finding("setup-execution", F.when(net != "", net).otherwise(danger), 1, name=name)),
    )
    rows = code.select("digest", "path", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("f"))
    place = F.when(F.col("path") == "setup.py", EARLY).otherwise(EARLY + 10)
    return rows.select("digest", F.lit("static").alias("stage"), "f.rule", "f.severity", "f.description", "f.evidence", (place + F.col("f.n")).cast("long").alias("ord"))


def content_rules(t: Column, low: Column) -> list[Column]:
    """A finding or null for each family of content rules, given the columns that `scanned` makes."""
    path, at = F.col("path"), lambda found: F.concat(F.col("path"), F.lit(": "), found)
    code, data, bundle, mini = ~F.col("test_doc"), F.col("data_config"), F.col("bundle"), F.col("minified")
    source, setup = code & ~data, F.col("setup")
    has = lambda *patterns: [found(t, low, p) for p in patterns]
    aws = first_found(t, low, fixed.AWS_KEY)
    secret = (
        F.when(found(t, low, fixed.PRIVATE_KEY), finding("private-key", path, 3, "secret"))
        .when((aws != "") & ~aws.endswith("EXAMPLE"), finding("aws-key", at(aws), 3, "secret"))
        .when(found(t, low, fixed.GENERIC_SECRET), finding("secret", path, 3, "secret"))
    )
    connect, bind, target = has(fixed.REV_SHELL_CONNECT, fixed.REV_SHELL_BIND, fixed.REV_SHELL_TARGET)
    idiom = first_found(t, low, fixed.REV_SHELL_IDIOM)
    shell = F.when(idiom != "", finding("shell-idiom", at(idiom), 4)).when(connect & bind & target, finding("shell-wired", at(first_match(t, fixed.REV_SHELL_TARGET)), 4))
    stratum, miner, config = has(fixed.STRATUM, fixed.MINER_BINARY, fixed.MINER_CONFIG)
    in_source = source & ~F.col("build") & ~bundle & ~mini & (base_name(path) != "package.json") & ~setup
    env = at(first_match(t, fixed.BULK_ENV))
    sends, quiet = code & found(t, low, fixed.ENV_EXFIL_SEND), code & ~bundle
    recon = quiet & (S.host_recon_exfil(t, low) | S.shell_recon_exfil(t, low))
    fetched = quiet & F.col("fetched").isNotNull()
    return [
        F.when(source & found(t, low, fixed.DYN_EXEC_DECODED), finding("exec-decoded", at(first_match(t, fixed.DYN_EXEC_DECODED)), 0)),
        F.when(code & F.col("endpoint").isNotNull(), finding("endpoint", at(F.col("endpoint")), 1)),
        F.when(code & F.col("encoded").isNotNull(), finding("encoded", at(S.truncate(F.col("encoded"), 120)), 2)),
        F.when(source, secret),
        F.when(source & ~bundle & ~mini, shell),
        F.when(stratum | (code & miner & config), finding("miner", path, 5)),
        F.when(in_source & found(t, low, fixed.DESTRUCTIVE), finding("wiper", at(first_match(t, fixed.DESTRUCTIVE)), 6)),
        F.when(sends, F.when(setup, finding("env-exfil-install", env, 7)).otherwise(finding("env-exfil-install", env, 7, gate=IN_HOOKS))),
        F.when(sends & ~setup, finding("env-exfil", env, 7, gate=ELSEWHERE)),
        F.when(recon, F.when(setup, finding("recon", path, 8)).otherwise(finding("recon", path, 8, gate=IN_HOOKS))),
        F.when(fetched, F.when(setup, finding("fetch", at(F.col("fetched")), 9)).otherwise(finding("fetch", at(F.col("fetched")), 9, gate=IN_HOOKS))),
        F.when(source & found(t, low, fixed.WEBHOOK), finding("webhook", at(first_match(t, fixed.WEBHOOK)), 10)),
        F.when(F.col("hex_obfuscated"), finding("obfuscated-js", path, 11)).when(F.col("py_obfuscated"), finding("obfuscated-py", path, 11)),
        F.when(S.looks_obfuscated(t, low, F.col("size"), F.col("longest")), finding("blob", path, 12)),
    ]


def scanned(files: DataFrame) -> DataFrame:
    """The files that rules look at, with their text, kind of path and costly values."""
    path, t, low = F.col("path"), F.col("text"), F.col("low")
    live = files.filter(~is_sbom(path) & ~is_package_metadata(path)).filter(~S.is_binary(F.col("content")))
    kinds = {"test_doc": is_test_or_doc, "data_config": is_data_config, "bundle": is_vendored_bundle, "build": is_build_tooling, "setup": is_setup_file}
    content = F.col("content")
    flagged = live.withColumns({"text": S.as_text(content), "size": F.octet_length(content), "longest": S.max_line_bytes(content)}).drop("content")
    # a long s folds to s, a case-blind pattern's partner that lower case doesn't reach
    flagged = flagged.withColumns({k: f(path) for k, f in kinds.items()}).withColumn("minified", F.col("longest") > 2000).withColumn("low", F.translate(F.lower(t), "\u017f", "s"))
    code = F.when(~F.col("test_doc"), t)
    costly = {"endpoint": S.hardcoded_public_endpoint(code), "encoded": S.decoded_network_indicator(code), "fetched": S.external_install_fetch(F.when(~F.col("bundle"), code), low), "hex_obfuscated": S.hex_obfuscated(t, low), "py_obfuscated": S.py_obfuscated(t, low, F.col("size"))}
    return flagged.withColumns(costly)


def content_findings(files: DataFrame, targets: DataFrame) -> DataFrame:
    """targets: digest, target."""
    rules = F.filter(F.array(*content_rules(F.col("text"), F.col("low"))), lambda x: x.isNotNull())
    hits = scanned(files).select("digest", "file_idx", base_name(F.col("path")).alias("target"), F.explode(rules).alias("f"))
    hooked = targets.select("digest", "target").distinct().withColumn("hooked", F.lit(IN_HOOKS))
    settled = hits.join(hooked, ["digest", "target"], "left").filter((F.col("f.gate") == ALWAYS) | (F.col("f.gate") == F.coalesce("hooked", F.lit(ELSEWHERE))))
    blob = F.col("f.family") == "obfuscated-blob"
    # blobs are told for every file but the one that is told as obfuscated code, all others for the first file
    told = F.min(F.when(F.col("f.family") == "obfuscated-code", F.col("file_idx"))).over(Window.partitionBy("digest"))
    nth = F.row_number().over(Window.partitionBy("digest", "f.family").orderBy("file_idx"))
    out = settled.withColumn("told", told).withColumn("nth", nth).filter((~blob & (F.col("nth") == 1)) | (blob & ~F.col("file_idx").eqNullSafe(F.col("told"))))
    return out.select("digest", F.lit("static").alias("stage"), "f.rule", "f.severity", "f.description", "f.evidence", (F.col("file_idx") * PER_FILE + F.col("f.n")).cast("long").alias("ord"))


def static_findings(files: DataFrame) -> DataFrame:
    """All static findings of the artifacts."""
    hooks = npm_hooks(files)
    return hook_findings(hooks).unionByName(setup_findings(files)).unionByName(content_findings(files, hook_targets(hooks)))
