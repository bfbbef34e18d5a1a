"""The corpus pipeline: each stage on its predecessor's rows, and the whole against brute force."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_quality_rules import prose
from test_repeats import brute, octets

from palisade.llm.quality_rules import quality


def corpus():
    rng = random.Random(12)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "src0", len(base[i])) for i in range(10)]
    rows += [(200 + i, base[20 + i] + " tail", "en", "src1", len(base[20 + i]) + 5) for i in range(10)]
    rows += [(300 + i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}", "en", "src2", 1) for i in range(5)]
    rows += [(400 + i, "JUNK!! " * 100, "en", "src1", 700) for i in range(3)] + [(500, None, "en", "src1", 0), (501, "", None, None, 0)]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mixture", "tokens"]
    (_, rules), (_, near), (_, cut), (_, mixed), (_, tokens) = corpus_pipeline.STAGES

    a = rules(spark, docs, "").cache()
    assert a.columns == names
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in quality(docs).filter("kept").collect()}
    assert not {400, 500, 501} & {r.doc_id for r in a.collect()} and set(range(60)) <= {r.doc_id for r in a.collect()}

    b = near(spark, a, "").cache()
    left = {r.doc_id for r in b.collect()}
    assert b.columns == names and set(range(60)) | set(range(300, 305)) == left

    c = cut(spark, b, "").cache()
    given = [(r.doc_id, r.text) for r in b.collect()]
    gone = brute(given, 100, octets)
    want = {d: bytes(x for x, g in zip(octets(t), gone[d, t], strict=True) if not g).decode("utf-8", "ignore") for d, t in given}
    assert c.columns == names and {r.doc_id: r.text for r in c.collect()} == want
    assert all(r.n_chars == len(r.text) for r in c.collect())

    m = mixed(spark, c, "").cache()
    assert m.columns == names
    times = {r.doc_id: r["count"] for r in m.groupBy("doc_id").count().collect()}
    assert set(times) <= left and max(times.values()) <= 3
    assert {(r.doc_id, r.text) for r in m.collect()} <= {(r.doc_id, r.text) for r in c.collect()}

    t = tokens(spark, m, "")
    assert t.count() == m.count() and t.filter(F.col("n_tokens") < 1).count() == 0

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, t.collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_tables(spark, tmp_path):
    """Empty tables, null ids, equal rows, and rows that differ outside id and text only: reruns agree."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key int"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), "").count() == 0
    rng = random.Random(13)
    texts = [prose(rng, 150) for _ in range(40)]
    rows = [(None if i % 3 == 0 else i, t, "en", f"s{i % 4}" if i % 5 else None, len(t), "r", 1) for i, t in enumerate(texts)]
    rows += [(1, texts[1], "en", "s1", 7, name, k) for name in ("x", "y", None) for k in (1, 2)] + [rows[2]] * 3 + [(None, None, None, None, None, None, None)] * 2
    runs = []
    for parts in (2, 5):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        out = docs
        sizes = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "").cache()
            sizes.append(out.count())
            assert out.columns == docs.columns
        assert sizes[0] == len(rows) - 2 and sizes[1] == sizes[2] == 40
        runs.append(sorted(map(str, out.collect())))
    assert runs[0] == runs[1]
    # rows equal in id and text are left to the mix as they are: its parts add up and don't depend on order
    (_, mixed) = corpus_pipeline.STAGES[3]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(str, mixed(spark, docs.repartition(7), "").collect())) == sorted(map(str, mixed(spark, docs.coalesce(1), "").collect()))
