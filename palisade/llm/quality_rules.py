"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common short words is compared with the reference of its
language by Jensen-Shannon distance. References are sums over the distinct texts of the language that pass the
base rules: the shares of the classes, and of the most common words of up to Rules.common_length characters (function
words are short; None takes words of any length, at the price of the whole text once more). Copies count once
and a text weighs MOST_WORDS and MOST_CHARS at most, so no hot or huge document becomes the language. A histogram judges
only documents, and is judged only by references, of a minimum length. Base rules on length and repetition come first.
DataFrame functions only.

Defined cases: null and empty texts have no words and fail the base rules; a null language is one of its own; a
language with little text judges nothing; repeated rows are judged alike; texts are read whole; an empty table gives
an empty result; other columns are ignored by `quality` and kept by `kept_documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize, text_name, words

#: Character classes in order of counting; what is left over is the last class.
CLASSES = {"lower": r"\p{Ll}+", "blank": r"[\x20\x09-\x0D]+", "upper": r"\p{Lu}+", "digit": r"\p{N}+", "mark": r"[.,;:!?'\"()-]+"}
#: A longer text weighs no more than this in the references: its words and characters count in parts of UNIT, so sums
#: are of whole numbers and don't depend on order.
MOST_WORDS, MOST_CHARS, UNIT = 1000, 6000, 10_000


@dataclass(frozen=True)
class Rules:
    """Base rules as the contract has them; limits of the distances; guards in characters and words."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    class_limit: float = 0.22
    word_limit: float = 0.355
    min_chars: int = 500
    min_words_judged: int = 60
    min_reference_words: int = 5000
    common_words: int = 24
    common_length: int | None = 4
    #: A common word makes up this share of its language's words at least, so a language has 1 / share of them at most.
    common_share: float = 0.0005


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def window_hashes(w: Column, window: int) -> Column:
    """Hash of each window of the words w, of which there are enough: hashes of pairs, of pairs of pairs and so on."""

    def joined(h: Column, shift: int) -> Column:
        n = lambda x: F.size(x) - shift
        return let(h, lambda x: F.zip_with(F.slice(x, 1, n(x)), F.slice(x, shift + 1, n(x)), lambda a, b: F.xxhash64(a, b)))

    h, size = F.transform(w, lambda x: F.xxhash64(x)), 1
    while size * 2 <= window:
        h, size = joined(h, size), size * 2
    return joined(h, window - size) if size < window else h


def repeated_words(w: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more among the words w."""
    hashes = window_hashes(w, window)

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        last = F.size(h) - 1

        def places(s: Column) -> Column:
            same = lambda j, k: F.get(s, j)["x"] == F.get(s, k)["x"]
            twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | ((j < last) & same(j, F.least(j + 1, last))))
            return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

        def span(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(ranked, places), span))

    return F.when(F.size(w) < window, 0).otherwise(let(hashes, covered)).cast("long")


def features(docs: DataFrame, rules: Rules = Rules(), *carried: str) -> DataFrame:
    """doc_id, the base features, class counts, and the short words of each whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda line: F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")) > 0)
    counted = F.col("w") if rules.common_length is None else F.filter("w", lambda x: F.char_length(x) <= rules.common_length)
    df = docs.select("doc_id", F.coalesce(F.concat(F.lit("a"), F.col("lang")), F.lit("n")).alias("lk"), t.alias("t"), *carried)
    df = df.withColumn("w", words(F.col("t"))).withColumn("lines", lines)
    df = df.select(
        "doc_id", "lk", *carried, F.col("t").alias("rest"), F.xxhash64("t").alias("text_hash"), F.char_length("t").alias("n_chars"), F.size("w").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), rules.repeat_window).alias("n_repeat_words"),
        F.lower(F.concat(F.lit(" "), F.concat_ws("  ", counted), F.lit(" "))).alias("short"),
    )
    for name, pattern in CLASSES.items():  # each pass leaves less to look at
        df = df.withColumn("next", F.regexp_replace("rest", pattern, ""))
        df = df.withColumn(name, F.char_length("rest") - F.char_length("next")).drop("rest").withColumnRenamed("next", "rest")
    counts = F.array(*[F.col(c).cast("long") for c in CLASSES], F.char_length("rest").cast("long"))
    return df.withColumn("classes", counts).drop("rest", *CLASSES)


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def references(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """lk, class_ref, common, common_ref: a row for each language with enough text."""
    n = len(CLASSES) + 1
    texts = found.filter(~base_failed(rules)).groupBy("lk", "text_hash", "n_chars", "n_words").agg(F.first("classes").alias("classes"), F.first("short").alias("short"))
    each = lambda size, most: F.greatest(F.lit(1), F.least(F.lit(UNIT), F.floor(F.lit(UNIT * most) / F.greatest(F.col(size), F.lit(1)))))
    texts = texts.withColumn("word", each("n_words", MOST_WORDS)).withColumn("char", each("n_chars", MOST_CHARS))
    sums = texts.groupBy("lk").agg(F.sum("n_words").alias("ref_words"), F.sum(F.col("n_words") * F.col("word")).alias("ref_weight"), F.array(*[F.sum(F.col("classes")[i] * F.col("char")) for i in range(n)]).alias("sums"))
    sums = sums.filter(F.col("ref_words") >= rules.min_reference_words)
    total = F.aggregate("sums", F.lit(0).cast("long"), lambda a, b: a + b)
    sums = sums.withColumn("total", total).select("lk", "ref_weight", F.transform("sums", lambda x: x / F.col("total")).alias("class_ref"))
    words_ = texts.select("lk", F.col("word").alias("each"), F.explode(F.split(F.trim("short"), "  ")).alias("word")).filter("word <> ''").groupBy("lk", "word").agg(F.sum("each").alias("weight"))
    shares = words_.join(sums.select("lk", "ref_weight"), "lk").filter(F.col("weight") >= rules.common_share * F.col("ref_weight"))
    rank = F.row_number().over(Window.partitionBy("lk").orderBy(F.desc("weight"), "word"))
    top = shares.withColumn("rank", rank).filter(F.col("rank") <= rules.common_words)
    top = top.groupBy("lk").agg(F.sort_array(F.collect_list(F.struct("rank", "word", (F.col("weight") / F.col("ref_weight")).alias("share")))).alias("top"))
    return sums.join(top, "lk", "left").select("lk", "class_ref", F.coalesce("top.word", F.array().cast("array<string>")).alias("common"), F.coalesce("top.share", F.array().cast("array<double>")).alias("common_ref"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two distributions."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2))


def judged(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """found with class_distance and word_distance (null where not judged), base_failed and kept."""
    rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(a, F.lit(0.0), lambda x, y: x + y))))
    size = F.octet_length("short")
    times = F.transform("common", lambda w: (size - F.octet_length(F.replace(F.col("short"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2) / F.col("n_words"))
    # a written table has a size that Spark knows: a small one is broadcast, and no language meets in one task
    both = found.join(materialize(references(found, rules)), "lk", "left")
    by_class = F.when((F.col("n_chars") >= rules.min_chars) & F.col("class_ref").isNotNull(), distance(F.transform("classes", lambda x: x / F.col("n_chars")), F.col("class_ref")))
    by_word = F.when((F.col("n_words") >= rules.min_words_judged) & (F.size("common") > 0), distance(rest(times), rest(F.col("common_ref"))))
    both = both.withColumn("class_distance", by_class).withColumn("word_distance", by_word).withColumn("base_failed", base_failed(rules))
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > rules.word_limit)
    return both.withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the two distances."""
    found = materialize(features(docs, rules))
    return judged(found, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, all columns. The verdict is a function of text and language, so it is
    joined by 128 bits of these and the id, once for equal rows."""
    names = docs.columns
    key = text_name(F.to_json(F.struct("doc_id", "lang")), F.col("text"))
    found = materialize(features(docs.select("doc_id", "text", "lang", key.alias("key")), rules, "key"))
    kept = judged(found, rules).filter("kept").select(F.col("key").alias("kept_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"))
    return rows.join(kept, F.col("key") == F.col("kept_key"), "left_semi").select("row.*")
