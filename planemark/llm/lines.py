"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over a threshold, and reassemble by
position."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() maps A-Z alone if all is ASCII, and is much faster than translate().
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)


def _hashes(min_chars: int) -> Column:
    """For each line (its number, two 64-bit hashes of its key); lines with too short keys are left out."""
    keys = F.transform(_lines(), lambda x, i: F.struct(i.alias("at"), line_key(x).alias("key")))
    keys = F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars)
    return F.transform(keys, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")))


#: Up to so many common lines their hashes (16 bytes each) are broadcast; more meet the lines in a shuffle.
BROADCAST_LINES = 500_000


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to `docs` (doc_id, text, and any other columns, which stay).

    Every line whose key has min_chars code points or more and stands in min_docs rows or more goes, in every row; a row counts
    once for a key however often it has it. Null or empty text: one empty line. Rows with null or repeated ids are rows like any
    other; texts of any length are split whole. An empty table gives an empty result. Columns of docs named like the new ones are
    replaced; other names cannot clash.
    """
    given = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    nested = F.struct(*(F.col(f"`{c}`") for c in given))
    # A row is known by its id and a hash of its text: equal rows are treated equally, so they may share a key.
    docs = docs.select(nested.alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("row_id"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_hash"))
    row = ["row_id", "row_hash"]
    hashed = docs.select(*row, _hashes(min_chars).alias("hashes"))
    per_doc = hashed.select(F.explode(F.array_distinct(F.transform("hashes", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("h"))
    common = stored(per_doc.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"), "common-lines")
    side = F.broadcast(common) if common.count() <= BROADCAST_LINES else common
    places = hashed.select(*row, F.inline("hashes"))
    drops = places.join(side, ["h1", "h2"], "left_semi").groupBy(*row).agg(F.collect_set("at").alias("drops"))
    joined = docs.join(drops, row, "left")
    drops_here = F.coalesce(F.col("drops"), F.array().cast("array<int>"))

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops_here)
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("kept_text"))

    # A lambda binds the split lines, so they are made once a row.
    out = joined.withColumn("kept", F.transform(F.array(_lines()), kept)[0])
    return out.select("row.*", F.col("kept.n_lines").alias("n_lines"), F.size(drops_here).cast("long").alias("n_dropped"), F.col("kept.kept_text").alias("kept_text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines without those found in 10 documents or more; nulls and repeats as in drop_common_lines."""
    out = drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, rid, pos, list_extract(lines, pos) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d, generate_series(1, len(lines)) g(pos)
), keyed AS (
  SELECT doc_id, rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id, k.rid
"""
