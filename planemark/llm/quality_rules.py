"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials, length-normalised, with
deterministic thresholding of every document, after a few base counts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 14
#: Log-likelihood ratios are whole millionths, so that sums do not hang on their order.
UNIT = 1_000_000


def _let(value: Column, body) -> Column:  # type: ignore[no-untyped-def]
    """body(value) with value made once a row."""
    return F.transform(F.array(value), body)[0]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of the text. Without tabs and the like, two plain replacements stand for the slower pattern."""
    plain = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1), "")
    bare = F.btrim(text, F.lit(BLANKS))
    full = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0b\\f\\r]+", -1))
    return F.when(text.rlike("[\\t\\x0b\\f\\r]"), full).otherwise(plain)


def pair_hashes(hashes: Column) -> Column:
    """A hash of each word and the next one; the last word has none."""
    return _let(hashes, lambda hs: F.transform(F.slice(hs, 1, F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hs, i + 1))))


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """How many words lie in windows of five words that stand twice or more in the document; a hash of each word and pair."""

    def twins(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        # Outside the array get() is null, and so is the comparison.
        hit = _let(placed, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        return F.aggregate(
            F.sort_array(F.transform(hit, lambda x: x["at"])),
            F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
            lambda a, at: F.struct((a["n"] + F.least(F.lit(5), at - a["last"])).alias("n"), at.alias("last")),
            lambda a: a["n"],
        )

    windows = F.transform(F.slice(pairs, 1, F.size(hashes) - 4), lambda p, i: F.xxhash64(p, F.get(pairs, i + 2), F.get(hashes, i + 4)))
    # Most documents have no window twice; only the others are sorted.
    counted = _let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), 0).otherwise(twins(ws)))
    return F.when(F.size(hashes) <= 5, 0).otherwise(counted).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and word_hashes."""
    text = _text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return docs.select(
        "doc_id",
        F.char_length(F.array_join(word_array(text), "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(word_array(text), lambda x: F.xxhash64(x)).alias("word_hashes"),
    )


def bucket(hash_: Column) -> Column:
    """The upper 14 bits of a 64-bit hash."""
    return F.shiftrightunsigned(hash_, 50).cast("int")


def _bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    """How many words and word pairs of docs fall in each bucket."""
    hashed = docs.select(F.transform(word_array(_text()), lambda x: F.xxhash64(x)).alias("hs"))
    grams = _let(F.col("hs"), lambda hs: F.concat(hs, pair_hashes(hs)))
    each = hashed.select(F.explode(grams).alias("h")).select(bucket(F.col("h")).alias("bucket"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def target_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with `weights`: for each of BUCKETS, the log ratio of its share in trusted documents to that in all, in UNITs.

    Both multinomials have one added to every bucket. The raw one counts all documents, the target all those of trusted ids; a
    shuffle join of any size that rows of null ids do not enter.
    """
    chosen = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    raw = _bucket_counts(docs, "raw").withColumn("target", F.lit(0).cast("long"))
    target = _bucket_counts(docs.where("doc_id IS NOT NULL").join(chosen.hint("merge"), "doc_id", "left_semi"), "target").select("bucket", F.lit(0).cast("long").alias("raw"), "target")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    whole = raw.unionByName(target).unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    row = whole.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"), F.sum("raw").alias("n"), F.sum("target").alias("m"))
    share = lambda x, n: F.log((x + 1).cast("double") / (n + BUCKETS))
    return row.select(F.transform("all", lambda x: F.round(UNIT * (share(x["target"], F.col("m")) - share(x["raw"], F.col("n")))).cast("long")).alias("weights"))


def score_quality(docs: DataFrame, trusted: DataFrame, threshold: float = -0.1, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Base counts, base_failed, llr (whole millionths a gram, null without words) and kept of every row of `docs` (doc_id, text).

    kept: not base_failed and llr >= threshold. Null text has no words and fails the base; rows with null or repeated ids are
    scored like any other; extra columns are left out; an empty table gives an empty result; without trusted rows every target
    share is equal, and the ratio still defined.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One row of BUCKETS numbers, whatever the input's size; as a literal, since lambdas take no scalar subquery.
    weights = target_weights(source, trusted).first()["weights"]
    w = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    counted = base_counts(source)
    counted = counted.withColumn("pairs", pair_hashes(F.col("word_hashes")))
    add = lambda a, h: a + F.get(w, bucket(h))
    parts = counted.select(
        "doc_id", F.size("word_hashes").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("word_hashes"), F.col("pairs")).alias("n_repeat_words"),
        F.aggregate("pairs", F.aggregate("word_hashes", F.lit(0).cast("long"), add), add).alias("sum_llr"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    limit = round(threshold * UNIT)
    return parts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("sum_llr") >= 2 * limit * F.col("n_words"))).alias("kept"),
        F.when(F.col("n_words") > 0, F.floor(F.col("sum_llr") / (2 * F.col("n_words")))).alias("llr"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict, the trusted ones being those labelled good; nulls and repeats as in score_quality."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return score_quality(read(spark, sf_dir, "documents"), trusted)
