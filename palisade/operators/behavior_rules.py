"""Findings from sandbox behaviour.

traces: digest, ecosystem, trace (the parsed struct of `sources.traces`). Phases count in the order install, import,
execute, then all others. Findings that need the whole trace are aggregates over its exploded events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions import scalars as S
from palisade.functions.paths import base_name, is_package_churn
from palisade.sources.scratch import cut

#: Room for the findings of one kind in one phase, more than an array can hold, and of one phase.
PER_KIND, PER_PHASE = 10**10, 10**11
PHASES = ["install", "import", "execute"]


#: One row of behaviour, whatever its kind.
EVENT = "kind string, pos long, path string, read boolean, write boolean, delete boolean, address string, port int, hostnames array<string>, command array<string>, host string"


def events(traces: DataFrame) -> DataFrame:
    """All entries of the traces in one pass: digest, ecosystem, phase, phase_ord and the columns of EVENT. pos is the
    entry's place among all of its phase: files, sockets, commands, then queries."""
    fields = [c.split(" ") for c in EVENT.split(", ")]

    def row(kind: str, **known: Column) -> Column:
        known |= {"kind": F.lit(kind)}
        return F.struct(*[(known[n] if n in known else F.lit(None)).cast(t).alias(n) for n, t in fields if n != "pos"])

    flag = lambda c: F.coalesce(c, F.lit(False))
    each = lambda name, f: F.coalesce(F.transform(F.col("p")[name], f), F.array())
    asked = lambda d: F.transform(d["Queries"], lambda q: row("dns", host=q["Hostname"]))
    rows = F.concat(
        each("Files", lambda f: row("file", path=f["Path"], read=flag(f["Read"]), write=flag(f["Write"]), delete=flag(f["Delete"]))),
        each("Sockets", lambda s: row("socket", address=s["Address"], port=s["Port"], hostnames=s["Hostnames"])),
        each("Commands", lambda c: row("command", command=c["Command"])),
        F.flatten(F.coalesce(F.filter(F.transform(F.col("p.DNS"), asked), lambda x: x.isNotNull()), F.array())),
    )
    known = F.array_position(F.array(*[F.lit(x) for x in PHASES]), F.col("phase"))
    order = F.when(known > 0, known).otherwise(len(PHASES) + 1).cast("int")
    opened = traces.select("digest", "ecosystem", F.explode("trace.Analysis").alias("phase", "p"))
    return opened.select("digest", "ecosystem", "phase", order.alias("phase_ord"), F.posexplode(rows).alias("pos", "e")).select("digest", "ecosystem", "phase", "phase_ord", F.col("pos").cast("long").alias("pos"), "e.*")


def _place(kind: int) -> Column:
    return (F.col("phase_ord").cast("long") * PER_PHASE + kind * PER_KIND + F.col("pos")).alias("ord")


def _told(rows: DataFrame, rule: Column, severity: Column, description: Column, evidence: Column, place: Column) -> DataFrame:
    return rows.select("digest", F.lit("behavior").alias("stage"), rule.alias("rule"), severity.alias("severity"), description.alias("description"), evidence.alias("evidence"), place.alias("ord"))


def _fixed(rows: DataFrame, key: str, word: Column | None, evidence: Column, place: Column) -> DataFrame:
    rule, severity, description = fixed.TRACE_RULES[key]
    told = F.lit(description) if word is None else F.format_string(description.replace("{}", "%s"), word.cast("string"))
    return _told(rows, F.lit(rule), F.lit(severity), told, evidence, place)


def during(text: Column) -> Column:
    return F.concat(text, F.lit(" during "), F.col("phase"))


def read_findings(files: DataFrame) -> DataFrame:
    rows = files.filter("read").withColumn("c", S.classify_read(F.col("path"))).filter("c IS NOT NULL")
    return _told(rows, F.concat(F.lit("sensitive-read:"), F.col("c.class")), F.col("c.severity"), during(F.concat(F.lit("reads "), F.col("c.class"))), F.col("path"), _place(0))


def write_findings(files: DataFrame) -> DataFrame:
    rows = files.filter("write").withColumn("c", S.classify_write(F.col("path"))).filter("c IS NOT NULL")
    return _told(rows, F.col("c.rule"), F.col("c.severity"), during(F.col("c.description")), F.col("path"), _place(0))


def command_findings(commands: DataFrame) -> DataFrame:
    rows = commands.withColumn("c", S.classify_command(F.col("command"))).filter("c IS NOT NULL")
    return _told(rows, F.col("c.rule"), F.col("c.severity"), during(F.col("c.description")), F.array_join("command", " "), _place(1))


def drop_and_execute(files: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands that name, by its path, a file dropped in the same or an earlier phase: one finding a command."""
    dropped = files.filter(F.col("write") & S.is_dropped_payload(F.col("path"))).groupBy("digest", base_name(F.col("path")).alias("name")).agg(F.min("phase_ord").alias("since"))
    words = commands.select("digest", "phase", "phase_ord", "pos", F.posexplode("command").alias("at", "word")).filter(F.col("word").contains("/"))
    hits = words.withColumn("name", base_name(F.col("word"))).join(dropped, ["digest", "name"]).filter("since <= phase_ord")
    first = hits.groupBy("digest", "phase", "phase_ord", "pos").agg(F.min_by("word", "at").alias("word"))
    return _fixed(first, "dropped", F.col("phase"), F.col("word"), _place(2))


def socket_findings(sockets: DataFrame) -> DataFrame:
    """Metadata endpoint, then mining port, then an address no name stands behind; the first that holds."""
    address, port = F.col("address"), F.col("port")
    kind = F.when(S.is_metadata_endpoint(address), "metadata").when(S.is_mining_port(port), "mining").when(S.connects_hardcoded_ip(address, F.col("hostnames")), "address")
    rows = sockets.withColumn("kind", kind)
    with_port = F.format_string("%s:%s", address, F.coalesce(port, F.lit(0)).cast("string"))
    parts = [_fixed(rows.filter(F.col("kind") == k), k, F.col("phase"), address if k == "metadata" else with_port, _place(3)) for k in ("metadata", "mining", "address")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def domain_findings(asked: DataFrame) -> DataFrame:
    return _fixed(asked.filter(S.is_unknown_domain(F.col("ecosystem"), F.col("host"))), "domain", F.col("phase"), F.col("host"), _place(4))


_LATE = 100 * PER_PHASE


def destruction(files: DataFrame, least: int = fixed.DESTRUCTION_DELETES) -> DataFrame:
    """Many deletes outside the package manager's own trees; the first three are told."""
    gone = files.filter(F.col("delete") & ~is_package_churn(F.col("path")))
    sums = gone.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("phase_ord", "pos", "path"))
    first = gone.withColumn("nth", nth).filter("nth <= 3").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("nth", "path"))).alias("f"))
    told = sums.join(first, "digest").withColumn("paths", F.array_join(F.transform("f", lambda x: x["path"]), ", "))
    return _fixed(told, "deletes", F.col("n"), F.col("paths"), F.lit(_LATE).cast("long"))


def recon_burst(commands: DataFrame, least: int = fixed.RECON_TOOLS) -> DataFrame:
    tools = commands.select("digest", S.recon_tool(F.col("command")).alias("tool")).groupBy("digest").agg(F.count_distinct("tool").alias("n")).filter(F.col("n") >= least)
    return _fixed(tools, "recon", F.col("n"), F.lit(None).cast("string"), F.lit(_LATE + 1).cast("long"))


def dns_exfil(asked: DataFrame, least: int = fixed.DNS_EXFIL_QUERIES) -> DataFrame:
    """Long sub-labels under one unknown parent; the busiest parent, of equals the smallest name."""
    h = S.bare_host(F.col("host"))
    long_ = asked.filter(S.is_unknown_domain(F.col("ecosystem"), h)).select("digest", h.alias("h"), S.parent_domain(h).alias("parent"))
    label = F.when(F.endswith("h", F.concat(F.lit("."), F.col("parent"))), F.octet_length("h") - F.octet_length("parent") - 1).otherwise(F.octet_length("h"))
    counts = long_.filter(label >= fixed.DNS_EXFIL_LENGTH).groupBy("digest", "parent").count()
    best = counts.groupBy("digest").agg(F.min(F.struct((-F.col("count")).alias("m"), "parent")).alias("b")).select("digest", (-F.col("b.m")).alias("n"), "b.parent").filter(F.col("n") >= least)
    return _fixed(best, "dns", F.col("n"), F.col("parent"), F.lit(_LATE + 2).cast("long"))


def exfil_chain(files: DataFrame, sockets: DataFrame, asked: DataFrame) -> DataFrame:
    """A credential was read and an unknown place was reached, in any order. Two flags in one aggregate."""
    c = S.classify_read(F.col("path"))
    secret = files.filter("read").select("digest", c.alias("c")).filter((F.col("c.severity").isin("high", "critical")) | F.col("c.class").isin("npm-token", "netrc")).select("digest", F.lit(1).alias("secret"), F.lit(0).alias("out"))
    reached = sockets.filter(S.is_metadata_endpoint(F.col("address")) | S.connects_hardcoded_ip(F.col("address"), F.col("hostnames"))).select("digest")
    reached = reached.unionByName(asked.filter(S.is_unknown_domain(F.col("ecosystem"), F.col("host"))).select("digest"))
    both = secret.unionByName(reached.select("digest", F.lit(0).alias("secret"), F.lit(1).alias("out"))).groupBy("digest").agg(F.max("secret").alias("secret"), F.max("out").alias("out")).filter("secret + out = 2")
    return _fixed(both, "chain", None, F.lit(None).cast("string"), F.lit(_LATE + 3).cast("long"))


def behavior_findings(traces: DataFrame) -> DataFrame:
    """All behaviour findings of the traces; those without an analysis have none. Traces are read once, into a table of
    events that the rules look at, each at its own kind and columns."""
    all_ = cut(events(traces))
    files, commands, sockets, asked = (all_.filter(F.col("kind") == k) for k in ("file", "command", "socket", "dns"))
    parts = [read_findings(files), write_findings(files), command_findings(commands), drop_and_execute(files, commands), socket_findings(sockets), domain_findings(asked), destruction(files), recon_burst(commands), dns_exfil(asked), exfil_chain(files, sockets, asked)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
