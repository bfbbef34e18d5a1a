"""Quotation linking on a small fixture, against a plain reading of the rules."""

import hashlib
import random
import re

import duckdb
import pandas as pd

from palisade.llm.queries import SQL
from palisade.llm.quotes import linked_conversations, sourced

LAST = (1 << 63) - 1
MARK = re.compile(r"^[ \t]*>(?:[ \t]*>)*[ \t]?")


def plain(rows):
    rows = set(rows)
    out = []

    def read(text):
        blocks, level0 = [], []
        prev = None
        for line in re.split(r"\r?\n", text or ""):
            m = MARK.match(line)
            level = m.group().count(">") if m else 0
            words = re.sub(r"[\s ]+", " ", line[m.end() :] if m else line).strip(" ")
            if not m:
                level0.append(line)
            if words:
                if prev == level:
                    blocks[-1][1].append(words)
                else:
                    blocks.append((level, [words]))
                prev = level
            else:
                prev = None
        return [(lv, " ".join(w).lower()) for lv, w in blocks], "\n".join(level0).strip("\n")

    def mid(r):
        return hashlib.md5("|".join([r[2] or "", str(r[2] is None).lower(), r[3] or "", str(r[3] is None).lower()]).encode()).hexdigest()

    msgs = {(r[0], LAST if r[1] is None else r[1], mid(r)): r for r in rows}
    info = {k: read(r[3]) for k, r in msgs.items()}
    parent, counts = {}, {}
    for k in msgs:
        quotes = [(lv, i, w) for i, (lv, w) in enumerate(info[k][0]) if lv > 0]
        found = []
        for lv, i, w in quotes:
            sources = [o for o in msgs if o[0] == k[0] and o[1] < k[1] and (any(v == 0 and x == w for v, x in info[o][0]) or " ".join(x for v, x in info[o][0] if v == 0) == w)]
            if sources:
                found.append((lv, i, max(sources, key=lambda o: o[1:])))
        counts[k] = (len(quotes), len(found))
        if found:
            parent[k] = min(found)[2]

    def path(k):
        return [*path(parent[k]), k] if k in parent else [k]

    for k, r in msgs.items():
        p = path(k)
        thread = sorted(([x[1:] for x in path(o)] for o in msgs if path(o)[0] == p[0]))
        fix = lambda t: None if t == LAST else t
        out.append((r[0], r[1], r[2], fix(p[0][1]), thread.index([x[1:] for x in p]), len(p) - 1, fix(parent[k][1]) if k in parent else None, *counts[k], info[k][1]))
    return out


FIXED = [
    (1, 0, "user", "Hello there\n\nSecond   part"), (1, 1, "assistant", "> hello THERE\nAnswer one"), (1, 2, "user", "> Second part\n\nAnswer two\nwrapped"),
    (1, 3, "assistant", ">> hello there\n> answer one\nDeep"), (1, 4, "user", "> Hello there Second part\r\nwhole"), (1, 5, "user", "> never said\nx"), (1, 6, "user", "> answer two wrapped"),
    (1, 7, "user", "  > > deep\n>Deep"), (2, 0, "user", "Hello there"), (2, 0, "user", "Hello there"), (2, 1, None, None), (None, 0, "user", "lone"), (None, 1, "user", "> lone\nyes"), (3, None, "user", "> a\nb"), (3, 1, "user", "a"), (3, 1, "tool", "a"), (4, 1, "user", ""),
]


def test_fixture(spark):
    rng = random.Random(1)
    rows = list(FIXED)
    for c in range(10, 16):
        said = []
        for t in range(12):
            lines = [f"line {rng.randrange(4)}" for _ in range(rng.randrange(1, 4))]
            if said and rng.random() < 0.6:
                lines = [">" * rng.randrange(1, 3) + " " + w for w in rng.choice(said)] + lines
            said.append([w for w in lines if w[0] != ">"])
            rows.append((c, t, "user", "\n".join(lines)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string")
    got = [tuple(r) for r in linked_conversations(df).select("conv_id", "turn", "role", "thread", "position", "depth", "parent_turn", "n_quotes", "n_linked", "text").collect()]
    key = lambda r: [repr(x) for x in r]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert max(r[5] for r in got) > 2
    assert linked_conversations(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM given")
    names = "conv_id, turn, role, thread, position, depth, parent_turn, n_quotes, n_linked, text"
    assert sorted(con.execute(f"SELECT {names} FROM ({SQL['op5_quotation_links']})").fetchall(), key=key) == sorted(got, key=key)


def test_long_chain(spark):
    """Every message answers the one before it, and each tenth gets a second answer."""
    rows = [(0, "m0 body")] + [(t, f"> m{t - 1} body\nm{t} body") for t in range(1, 150)] + [(1000 + t, f"> m{t} body\nside {t}") for t in range(0, 150, 10)]
    df = spark.createDataFrame([(7, t, "user", w) for t, w in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in linked_conversations(df).collect()}
    assert all(got[t].depth == got[t].position == t and got[t].thread == 0 for t in range(150))
    # side answers come when the chain below their original has been read, the deepest first
    assert [t for t in sorted(got, key=lambda t: got[t].position)][150:] == [1000 + t for t in range(140, -1, -10)]
    assert all(got[1000 + t].depth == t + 1 for t in range(0, 150, 10))


def test_spans(spark):
    """A passage told many times in one conversation: the latest earlier one counts, however turns are cut."""
    rng = random.Random(3)
    rows = [("c", "h", rng.randrange(-20, 60), f"m{i}", rng.randrange(2), i) for i in range(120)] + [("c", "h", LAST, "n", 1, 500), ("c", "k", 5, "a", 1, 501)]
    df = spark.createDataFrame(rows, "ck string, hash string, turn long, mid string, level int, block long")
    want = {r[5]: max(((o[2], o[3]) for o in rows if o[1] == r[1] and o[4] == 0 and o[2] < r[2]), default=None) for r in rows}
    for span in (1, 7, 4096):
        assert {r.block: r.source and tuple(r.source) for r in sourced(df, span).collect()} == want
