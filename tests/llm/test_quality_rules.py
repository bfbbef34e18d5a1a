"""Quality rules: base features against a plain count, verdicts against SQL, odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd

from palisade.llm.quality_rules import Rules, features, judged, kept_documents, quality
from palisade.llm.queries import SQL

COMMON = ["the", "of", "and", "to", "in", "is", "it", "on"]


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(3, 12))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus():
    rng = random.Random(6)
    out = [(i, "\n".join(prose(rng, 40) for _ in range(rng.randrange(1, 6))), "en") for i in range(120)]
    out += [(200 + i, "!! ".join(prose(rng, 200).upper().split()), "en") for i in range(4)]
    out += [(210 + i, " ".join(w + rng.choice(["***", "$$$", "&&&", "%%%"]) for w in prose(rng, 200).split()), "en") for i in range(4)]
    out += [(220 + i, " | ".join("".join(rng.choices("aeiou", k=9)) for _ in range(90)), "en") for i in range(4)]
    out += [(230, "spam eggs " * 90, "en"), (231, prose(rng, 10), "en"), (232, None, "en"), (233, "", None), (234, " \n\t ", "xx"), (None, prose(rng, 100), None), (235, "line one\nline one\n\n \nline two\r\nline one\n" * 3, "en")]
    out += [(236, "x" * 50_000, "en"), (237, prose(rng, 6000), "en"), (5, out[5][1], "en"), (5, "twin " + out[5][1], "en"), (238, "日本語 " * 30, "ja")]
    return out


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_features(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, w int, short int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality(docs).collect()]
    want = []
    for d, t, _ in rows:
        f = plain(t)
        want.append((d, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality(docs).collect()}
    assert all(kept[i] for i in range(120) if len(rows[i][1].split()) >= 20)
    assert not any(kept[i] for i in [*range(200, 204), *range(210, 214), *range(220, 224), 230, 231, 232])
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang FROM given")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({SQL['op4_quality_rules']})").fetchall()))
    assert want == sorted(str(tuple(r)) for r in quality(docs).select(names).collect())


def test_distances(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    found = features(docs)
    rows = judged(found).filter("class_distance IS NOT NULL").select("classes", "class_ref", "n_chars", "class_distance").limit(20).collect()
    for r in rows:
        p, q = [x / r.n_chars for x in r.classes], r.class_ref
        term = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0
        assert abs(r.class_distance - math.sqrt(sum(term(a, b) + term(b, a) for a, b in zip(p, q, strict=True)) / 2)) < 1e-9
    assert judged(found, Rules(min_reference_words=10**9)).filter("class_distance IS NOT NULL OR word_distance IS NOT NULL").count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(corpus())], "doc_id long, text string, lang string, key int")
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality(docs).filter("kept").count()
    assert kept_documents(docs.limit(0)).count() == quality(docs.limit(0)).count() == 0


def test_hot_texts(spark):
    """Copies and one huge text are not the language: with a third of rows being copies of a junk text, passing the base
    rules or failing them, clean texts stay and junk goes."""
    rng = random.Random(8)
    clean = [(i, prose(rng, 150), "en") for i in range(120)]
    junk = [(200 + i, " | ".join("".join(rng.choices("aeiou", k=9)) for _ in range(90)), "en") for i in range(4)]
    passing, failing = junk[0][1], "| spam " * 400
    huge = " | ".join("".join(rng.choices("aeiou", k=9)) for _ in range(30_000))
    for hot in [[passing] * 62, [failing] * 62, [huge]]:
        docs = spark.createDataFrame(clean + junk + [(1000 + i, t, "en") for i, t in enumerate(hot)], "doc_id long, text string, lang string")
        kept = {r.doc_id: r.kept for r in quality(docs).collect()}
        assert [i for i in range(120) if not kept[i]] == [], hot[0][:20]
        assert not any(kept[i] for i in kept if i >= 200), hot[0][:20]
        assert {r.doc_id for r in kept_documents(docs).collect()} == set(range(120))


def test_words_of_any_length(spark):
    """Rules.common_length: texts whose long words alone are foreign differ only where these count."""
    rng = random.Random(21)
    short, own, foreign = ["of", "the", "and", "to", "in"], [f"ownword{i}" for i in range(12)], [f"foreign{i}" for i in range(12)]
    make = lambda pool: " ".join(w for _ in range(60) for w in (rng.choice(short), rng.choice(pool)))
    rows = [(i, make(own), "xx") for i in range(120)] + [(500 + i, make(foreign), "xx") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = {r.doc_id: r.word_distance for r in quality(docs).collect()}
    all_ = {r.doc_id: r.word_distance for r in quality(docs, Rules(common_length=None)).collect()}
    assert max(few[i] for i in range(500, 504)) < 0.2 and min(all_[i] for i in range(500, 504)) > 0.5 and max(all_[i] for i in range(120)) < 0.3
