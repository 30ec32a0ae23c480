"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import literal_array, words

#: A blank, as a Java regular expression.
BLANK = r"[ \t-\r]"
#: Hashed features: words and pairs of neighbouring words, in lower case.
FEATURES = 1 << 13
#: N-grams of the raw corpus that are added to the target, in its own shares: with few trusted documents all ratios are near one.
PRIOR = 4.0 * FEATURES
#: Most trusted documents whose n-grams make the target: those of the smallest hash.
MOST_TRUSTED = 20_000
#: Least mean log-likelihood ratio of a document that is kept, in nats an n-gram.
THRESHOLD = -0.08
WINDOW, REPEATED_PERCENT, LEAST_WORDS = 8, 30, 20
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _pairs(hashes: Column, apart: int) -> Column:
    """Hashes of each element with the one `apart` places on."""
    rest = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), rest), F.slice(hashes, F.lit(apart + 1), rest), lambda a, b: F.xxhash64(a, b))


def _repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def lower_words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.array_remove(F.split(F.lower(text), BLANK), "")


def base(rows: DataFrame) -> DataFrame:
    """rows (whose columns are row and text) with the base counts, base_failed, and `singles` and `pairs`: the hashes of the lower-case words, and of words with their next.

    A text in which two windows of 8 words are equal has two equal runs of 4 words, also in lower case: only where two hashes of such runs are equal are windows looked for, word by word as they are. The hashes of runs are doublings of those that the score needs anyway.
    """
    near = lambda k, w: F.coalesce(F.get(F.col("placed"), k)["h"] == w["h"], F.lit(False))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    cover = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i.cast("long"))).cast("long").alias("n"), (i + WINDOW).cast("long").alias("end"))
    if_suspect = lambda column: F.when(F.col("suspect"), column)
    return (
        rows.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
        .withColumn("parts", F.split(F.lower("text"), BLANK))
        .withColumn("singles", F.transform(F.array_remove("parts", ""), lambda w: F.xxhash64(w)))
        .withColumn("pairs", _pairs(F.col("singles"), 1))
        .withColumn("suspect", (F.size("singles") > WINDOW) & _repeats(_pairs(F.col("pairs"), 2)))
        .withColumn("w1", if_suspect(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))))
        .withColumn("w2", _pairs(F.col("w1"), 1))
        .withColumn("w4", _pairs(F.col("w2"), 2))
        .withColumn("w8", _pairs(F.col("w4"), 4))
        .withColumn("placed", F.when(F.col("suspect") & _repeats(F.col("w8")), F.sort_array(F.transform("w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("starts", F.sort_array(F.transform(F.filter("placed", lambda w, k: near(k - 1, w) | near(k + 1, w)), lambda w: w["i"])))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
        .select(
            "row",
            "singles",
            "pairs",
            F.size("singles").cast("long").alias("n_words"),
            # Lower case can be longer, but has as many blanks.
            (F.length("text") - F.size("parts") + 1).cast("long").alias("word_chars"),
            (F.size(F.split("text", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.aggregate("starts", none, cover, lambda a: a["n"]), F.lit(0)).cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))
    )


def feature(hashed: Column) -> Column:
    """The feature of a hash: its low bits."""
    return hashed.bitwiseAND(F.lit(FEATURES - 1)).cast("int")


def weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """For each feature, the log of its share in the trusted target (with PRIOR n-grams of the raw corpus added) over its share in the raw corpus. Counts cover every document; the target is at most MOST_TRUSTED documents that labels call good (quality 1, not toxic). No such document: all zero.

    Words are put in rows beside their next, so that hashing and counting run in generated code, and counted in each task before the shuffle.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    trusted = good.select(F.col("doc_id").alias("good_id")).distinct().orderBy(F.xxhash64("good_id"), "good_id").limit(MOST_TRUSTED)
    each = docs.select("doc_id", lower_words(F.coalesce(F.col("text"), F.lit(""))).alias("words")).join(F.broadcast(trusted), F.col("doc_id") == F.col("good_id"), "left")
    beside = F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))
    hashed = each.select(F.col("good_id").isNotNull().alias("good"), F.explode(beside).alias("w")).select("good", F.xxhash64("w.a").alias("a"), F.when(F.col("w.b").isNotNull(), F.xxhash64("w.b")).alias("b"))
    both = hashed.select("good", F.explode(F.array(feature(F.col("a")), F.when(F.col("b").isNotNull(), feature(F.xxhash64("a", "b"))))).alias("feature"))
    counts = both.filter("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))
    raw, target = [0] * FEATURES, [0] * FEATURES
    for r in counts.collect():  # FEATURES rows at most
        raw[r["feature"]], target[r["feature"]] = r["raw"], r["target"]
    return ratios(raw, target)


def ratios(raw: list[int], target: list[int]) -> list[float]:
    """The log-likelihood ratio of each feature from its counts; zero without a target or where there is nothing to compare."""
    if not sum(target):
        return [0.0] * FEATURES
    all_raw, all_target = sum(raw), sum(target)
    return [log((t * all_raw / r + PRIOR) / (all_target + PRIOR)) if r else 0.0 for t, r in zip(target, raw, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs as a struct `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    score is the log-likelihood ratio of the text's hashed words and word pairs between the trusted target and the raw corpus, divided by their number; a text is kept if no base rule fails it and its score is at least threshold.
    Null, empty and blank texts have no words, score 0 and fail the base rules. Repeated rows and null ids are judged like any other. Without labels nothing is failed by score. An empty table gives an empty one. Other columns are carried in `row`, whatever their names.
    """
    table = literal_array(weights(docs, labels))
    worth = lambda a, h: a + F.get(table, feature(h))
    total = F.aggregate("pairs", F.aggregate("singles", F.lit(0.0), worth), worth)
    score = F.when(F.size("singles") > 0, total / (F.size("singles") + F.size("pairs"))).otherwise(0.0)
    judged = base(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    judged = judged.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # Filters must not be pushed below what they are made from, where the optimizer would repeat every array expression. None is pushed through a generator; this one makes one row of each.
    return judged.select("row", F.explode(F.array(F.struct(*RESULTS))).alias("its")).select("row", "its.*")
