"""A corpus pipeline over `documents`: quality classifier, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planemark.llm import lines, ngram_join, packing, quality_classifier, suffixes
from planemark.llm.common import read, stored

#: A repeated passage has more words than this. Its candidates are strings of PASSAGE_BYTES that repeat: 51 words have 101 bytes at least,
#: and hashes of strings take a multiple of 8.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 96


def _nested(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one column `given` beside some of its own, so that no other name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"), *(c for c in columns if c in docs.columns))


def _with_text(docs: DataFrame, changed: DataFrame, text: Column) -> DataFrame:
    """The columns of docs from `changed` (as from _nested), with the new text and, if there, its length."""
    out = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return changed.select(*((out[c] if c in out else F.col(f"given.`{c}`")).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Labels of the table `labels`: good is of quality and not toxic.

    Null or empty text is judged by its metadata and as a text of no words; null and repeated ids, equal rows and texts of any length
    are judged like others; without labels of both classes all stay. An empty table stays empty. Any other columns stay.
    """
    labels = quality_classifier.good_labels(read(spark, sf_dir, "labels"))
    return quality_classifier.classify(_nested(docs, "doc_id", "text", "lang", "source", "n_chars"), labels).where("quality_kept").select("given.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; every document stays, if need be with an empty text.

    Null text becomes empty. Null and repeated ids, equal rows and texts of any length are treated like others. An empty table stays
    empty. Any other columns stay; n_chars, if there, is counted anew.
    """
    return _with_text(docs, lines.drop_common_lines(_nested(docs, "doc_id", "text"), min_docs=10), F.col("kept_text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 of their five-word shingles, the one with the smallest id stays.

    A null id comes after all others; among rows of one id the smallest hash of id and text stays. Rows are told apart by id and
    text, so rows that share an id, or have none, go only if they are copies themselves; of those with one text one stays. Null and
    empty texts are linked with nothing, and of those with one id one stays. An empty table stays empty. Any other columns stay.
    """
    own = _nested(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    classes = ngram_join.similarity_classes(own.select(F.col("row").alias("doc_id"), "text"), size=5, percent=80)
    members = classes.select(F.col("doc_id").alias("row"), "component_id").distinct().join(own.select("row", "doc_id").distinct(), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = members.groupBy("component_id").agg(first).select("first.row")
    kept = own.join(stay, "row", "left_semi")
    return kept.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["row", "doc_id", "digest"]).select("given.*")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than PASSAGE_WORDS words, in strings that stand twice or more in the corpus, go in every place; every document
    stays, and no word is torn.

    Null text becomes empty. Null and repeated ids and texts of any length are treated like others; equal rows repeat one another. An
    empty table stays empty. Any other columns stay; n_chars, if there, is counted anew.
    """
    sliced = suffixes.repeated_bytes(docs.select("doc_id", "text"), PASSAGE_BYTES, keep_text=True, least_words=PASSAGE_WORDS + 1).where("n_removed > 0")
    sliced = sliced.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("given_sha256").alias("digest"), "kept_text").dropDuplicates(["id", "none", "digest"])
    # The text travels once, within `given`.
    own = _nested(docs, "text", "doc_id").select("given", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"), F.sha2("text", 256).alias("digest"))
    return _with_text(docs, own.join(sliced, ["id", "none", "digest"], "left"), F.coalesce("kept_text", "given.text", F.lit("")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens. Null or empty text is one piece, the end id; null and repeated ids,
    equal rows and texts of any length are packed like others; an empty table gives no pieces; other columns are left out."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained weights, hashes and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
