"""Registered queries do the whole job: no rows are left out by id."""

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.plans import queries_packages as packages
from palisade.plans import queries_tables as tables
from palisade.sources.tables import traces as parse

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "events", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def same(con, sql, df):
    want = sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()))
    assert sorted(str(tuple(r)) for r in df.collect()) == want


def test_every_document_is_a_file(spark, con):
    files = packages.artifact_files(spark, D)
    n = con.execute("SELECT count(*), count(*) FILTER (doc_id % 20 = 0) FROM documents").fetchone()
    assert files.count() == sum(n)
    texts = {bytes(r.content).decode() for r in files.collect()}
    assert all(any(f"{t}\n{line}\n" in texts for _, line in packages.LINES) for (t,) in con.execute("SELECT text FROM documents").fetchall())
    for name in ("package_findings", "package_verdicts", "package_excerpts"):
        same(con, packages.SQL[name], packages.QUERIES[name](spark, D))


def test_every_event_is_in_a_trace(spark, con):
    lists = ["Files", "Sockets", "Commands", "DNS"]
    parts = parse(packages.event_traces(spark, D)).select(F.explode(F.map_values("trace.Analysis")).alias("p")).select(*[F.size(f"p.{x}").alias(x) for x in lists])
    assert parts.agg(sum(F.sum(x) for x in lists)).first()[0] == con.execute("SELECT count(*) FROM events").fetchone()[0]
    same(con, packages.SQL["behavior_findings"], packages.QUERIES["behavior_findings"](spark, D))
    same(con, packages.SQL["behavior_verdicts"], packages.QUERIES["behavior_verdicts"](spark, D))


def test_every_source_and_advisory(spark, con):
    names = sorted((x for (x,) in con.execute("SELECT DISTINCT source FROM documents").fetchall()), key=lambda x: int(x[3:]))
    got = tables.version_diff(spark, D)
    assert got.select("digest").distinct().count() == len(names) - 1
    same(con, tables.SQL["version_diff"], got)
    same(con, tables.SQL["vuln_lookup"], tables.vuln_lookup(spark, D))
    assert tables.vuln_lookup(spark, D).count() == con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
