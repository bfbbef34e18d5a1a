"""Mixing: the op's rows against SQL and plain arithmetic."""

import random

import duckdb
import pandas as pd

from palisade.llm.mixing import mix, mixed_documents
from palisade.llm.queries import SQL

ROWS = [(None, "a b", "x"), (None, None, None), (5, "one two three", "x"), (5, "one two three", "x"), (6, "", "empty"), (7, "w " * 900, "big"), (8, " \t\n", "empty")]


def corpus():
    rng = random.Random(2)
    return ROWS + [(10 + i, "w " * rng.randrange(60), rng.choice(["big"] * 5 + ["x", "é", "z", None])) for i in range(300)]


def fill(sizes, weights, total):
    """Water filling by hand: raise all by weight until none is above three times its size."""
    done = {}
    while True:
        left, open_ = total - sum(done.values()), [k for k in sizes if k not in done]
        over = [k for k in open_ if weights[k] * left / sum(weights[j] for j in open_) > 3 * sizes[k]]
        if not over:
            return done | {k: weights[k] * left / sum(weights[j] for j in open_) for k in open_}
        done |= {k: 3 * sizes[k] for k in over}


def test_targets_and_takes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, key int").repartition(5)
    got = mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").toPandas()
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()))
    assert (got.taken <= 3 * got["size"]).all() and len(got) >= len(rows)
    with_id = got[got.doc_id.notna()].drop_duplicates(["doc_id", "taken"])
    for s in names:
        part = with_id[with_id.source == s] if s else with_id[with_id.source.isna()]
        assert (abs(part.target - want[s]) < 1e-6).all()
    again = mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert again[key].sort_values(key).reset_index(drop=True).equals(mix(docs).toPandas()[key].sort_values(key).reset_index(drop=True))


def test_sums_and_sql(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).toPandas()
    sums = got.groupby(["target", "source_size"]).taken.sum()
    assert all(abs(t - s) <= 1 for (t, _), s in sums.items())
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM given")
    order = ["doc_id", "size", "taken", "target"]
    want = con.execute(SQL["op1_mixing"]).df().sort_values(order).reset_index(drop=True)
    assert want[order].astype(float).equals(got.sort_values(order).reset_index(drop=True)[order].astype(float))


def test_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, source string, row int")
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    given, times = {}, {}
    for r in docs.collect():
        given[tuple(r)] = given.get(tuple(r), 0) + 1
    for r in mixed.collect():
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert set(times) <= set(given) and all(n <= 3 * given[k] for k, n in times.items())
    assert mixed_documents(docs.limit(0)).count() == mix(docs.limit(0)).count() == 0
