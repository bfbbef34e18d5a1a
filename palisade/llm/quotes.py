"""Quotation linking for chat formatting.

Lines that begin with '>' signs are quoted, one level a sign. Runs of lines of one level, ended by blank lines, are
passages. Passages are normalised (lower case, blanks collapsed) and hashed; a quoted passage is joined to the latest
earlier message of its conversation that has it as a passage of its own or as its whole body. A message replies to the
original of its first quote at the least level that has one. Threads are the trees of replies; a conversation reads
thread by thread, each in the order of replies (depth first, by turn), without the quoted lines. DataFrame functions
only.

Defined cases: null and blank texts have no passages and become ''; a null conv_id is a conversation of its own; a null
turn comes last; equal rows are one message, rows that differ but share a turn are different messages; a message
without quotes, or whose quotes are not found, begins a thread; an empty table gives an empty result; other columns
are ignored. Texts are read whole; a chain of replies may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize

QUOTE = r"^[ \t]*>(?:[ \t]*>)*[ \t]?"
NO_TURN = (1 << 63) - 1
#: Turns in one span, see sourced.
SPAN = 4096


def messages(conversations: DataFrame) -> DataFrame:
    """ck (non-null conversation key), turn, mid (tells messages of one turn apart) and the row's own columns."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("given"), "role", "text").distinct()
    return rows.select(
        "conv_id", "given", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("a"), F.col("conv_id").cast("string")), F.lit("n")).alias("ck"),
        F.coalesce("given", F.lit(NO_TURN)).alias("turn"), F.md5(F.concat_ws("|", F.coalesce("role", F.lit("")), F.col("role").isNull().cast("string"), F.coalesce("text", F.lit("")), F.col("text").isNull().cast("string"))).alias("mid"),
    )


def passages(found: DataFrame) -> DataFrame:
    """ck, turn, mid, block, level, words (normalised text) of every passage."""
    lines = found.select("ck", "turn", "mid", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    mark = F.regexp_extract("raw", QUOTE, 0)
    lines = lines.select("ck", "turn", "mid", "line", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.trim(F.regexp_replace(F.regexp_replace("raw", QUOTE, ""), r"[\s ]+", " ")).alias("words"))
    message = Window.partitionBy("ck", "turn", "mid").orderBy("line")
    before = F.lag(F.struct("level", (F.col("words") == "").alias("blank"))).over(message)
    lines = lines.withColumn("starts", F.when(before.isNull() | before["blank"] | (before["level"] != F.col("level")), 1).otherwise(0))
    lines = lines.withColumn("block", F.sum("starts").over(message)).filter("words <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "words"))), lambda x: x["words"]), " ")
    return lines.groupBy("ck", "turn", "mid", "block", "level").agg(F.lower(joined).alias("words"))


def links(found: DataFrame) -> DataFrame:
    """A row a quoted passage: ck, turn, mid, level, block, and its original's source_turn and source_mid or null."""
    parts = materialize(passages(found).withColumn("hash", F.md5("words")))
    quoted = parts.filter("level > 0").select("ck", "turn", "mid", "hash", "level", "block")
    own = parts.filter("level = 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "words"))), lambda x: x["words"]), " ")
    bodies = own.groupBy("ck", "turn", "mid").agg(F.md5(body).alias("hash"))
    originals = own.select("ck", "turn", "mid", "hash").unionByName(bodies).distinct()
    both = quoted.unionByName(originals.withColumn("level", F.lit(0)).withColumn("block", F.lit(None).cast("long")))
    return sourced(both).filter("level > 0").select("ck", "turn", "mid", "level", "block", F.col("source.turn").alias("source_turn"), F.col("source.mid").alias("source_mid"))


def sourced(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """rows (ck, hash, turn, mid, level 0 for an original) with source: the latest original of an earlier turn, or null.
    Turns are cut into spans: a row looks into its own span, then at what the spans before it end with, so that a
    passage which fills one conversation is many tasks' work."""
    rows = rows.withColumn("span", F.expr(f"turn div {span}"))
    original = F.when(F.col("level") == 0, F.struct("turn", "mid"))
    spans = Window.partitionBy("ck", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("ck", "hash", "span").agg(F.max(original).alias("best")).withColumn("before", F.max("best").over(spans)).drop("best")
    within = Window.partitionBy("ck", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.max(original).over(within)).join(ends, ["ck", "hash", "span"])
    return found.withColumn("source", F.coalesce("near", "before")).drop("near", "before", "span")


def reply_order(replies: DataFrame) -> DataFrame:
    """ck, turn, mid, root, position, depth of every message that replies or is replied to. replies: ck, turn, mid, parent.

    Each thread is walked round once: a message is entered, then its replies by turn, then it is left. The walk is a
    list of which every step knows the next; steps double in length each round (list ranking), so a chain of replies
    costs rows in proportion to its length, each of a fixed size.
    """
    edges = replies.select("ck", F.struct("turn", "mid").alias("at"), "parent")
    siblings = Window.partitionBy("ck", "parent").orderBy("at")
    nodes = edges.withColumn("sibling", F.lead("at").over(siblings))
    roots = edges.select("ck", F.col("parent").alias("at")).distinct().join(edges.select("ck", "at"), ["ck", "at"], "left_anti")
    nodes = nodes.unionByName(roots, allowMissingColumns=True)
    first = edges.groupBy("ck", F.col("parent").alias("at")).agg(F.min("at").alias("first"))
    step = lambda at, side: F.struct(F.col(at).alias("at"), F.lit(side).alias("side"))
    entered = nodes.join(first, ["ck", "at"], "left").select("ck", step("at", 0).alias("step"), F.when(F.col("first").isNotNull(), step("first", 0)).otherwise(step("at", 1)).alias("next"), F.lit(1).alias("climb"))
    left = nodes.select("ck", step("at", 1).alias("step"), F.when(F.col("sibling").isNotNull(), step("sibling", 0)).when(F.col("parent").isNotNull(), step("parent", 1)).alias("next"), F.lit(-1).alias("climb"))
    walk = entered.unionByName(left).select("ck", "step", "next", F.col("climb").cast("long"), F.when(F.col("climb") > 0, 1).otherwise(0).cast("long").alias("entries"), F.col("step.at").alias("root"))
    walk = materialize(walk)
    while not walk.filter("next IS NOT NULL").isEmpty():
        on = walk.select("ck", F.col("step").alias("next"), F.col("next").alias("over"), F.col("climb").alias("climb_on"), F.col("entries").alias("entries_on"), F.col("root").alias("root_on"))
        both = walk.join(on, ["ck", "next"], "left")
        walk = materialize(both.select("ck", "step", F.col("over").alias("next"), (F.col("climb") + F.coalesce("climb_on", F.lit(0))).alias("climb"), (F.col("entries") + F.coalesce("entries_on", F.lit(0))).alias("entries"), F.coalesce("root_on", "root").alias("root")))
    sizes = walk.groupBy("ck", "root").agg(F.max("entries").alias("size"))
    return walk.filter("step.side = 0").join(sizes, ["ck", "root"]).select("ck", F.col("step.at.turn").alias("turn"), F.col("step.at.mid").alias("mid"), "root", (F.col("size") - F.col("entries")).alias("position"), (-F.col("climb")).alias("depth"))


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, thread (turn that begins it), position in it, depth, parent_turn, n_quotes, n_linked, text."""
    found = messages(conversations)
    quoted = materialize(links(found))
    per = quoted.groupBy("ck", "turn", "mid").agg(
        F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked"),
        F.min_by(F.struct(F.col("source_turn").alias("turn"), F.col("source_mid").alias("mid")), F.when(F.col("source_turn").isNotNull(), F.struct("level", "block"))).alias("parent"),
    )
    replies = per.filter("n_linked > 0").select("ck", "turn", "mid", "parent")
    order = reply_order(replies)
    kept = F.array_join(F.filter(F.split("text", r"\r?\n"), lambda line: ~line.rlike(QUOTE)), "\n")
    out = found.join(per, ["ck", "turn", "mid"], "left").join(order, ["ck", "turn", "mid"], "left")
    turn = lambda c: F.when(c != NO_TURN, c)
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", F.col("given").alias("turn"), "role", turn(F.coalesce(F.col("root.turn"), F.col("turn"))).alias("thread"), whole("position"), whole("depth"), turn(F.col("parent.turn")).alias("parent_turn"),
        whole("n_quotes"), whole("n_linked"), F.regexp_replace(kept, r"^\n+|\n+$", "").alias("text"),
    )
