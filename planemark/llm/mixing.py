"""Mixing sources to target weights: systematic sampling. Each document's expected copies are summed up within its source, one random
offset is added, and the document is emitted once for each whole number that its step of the sum crosses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered, running
from .common import read, stored

#: Weights of the sources in the order of their names, from the first again after the last.
WEIGHTS = (5, 2, 1)
#: Times its own size that a source is taken at most.
MOST = 3
#: Expected copies and offsets are whole numbers of this part of a copy, so that no sum is rounded.
PART = 1 << 32


def count_words(text: Column) -> Column:
    """How many runs of anything but space, tab, LF, VT, FF and CR; null: none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # A word is where white space, or the text's start, is followed by something else.
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0b\\f\\r]++")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of `sizes` (source, size), one row a source, by code points, null last.

    The targets add up to the sum of all sizes and are as the weights, but none is over `most` times its source; what such a source
    leaves goes to the others by weight, again and again. That ends with one level for each unit of weight: sources in the order of
    their room for a unit of weight stop one after the other, which running sums decide.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = numbered(totals.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "_at")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    rows = stored(named.select("source", "source_size", "_at", weight.alias("_w"), (most * F.col("source_size")).alias("_room")), "sources")
    total, weight_sum = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    summed = running(rows, [F.col("_room") / F.col("_w"), F.col("_at")], {"_rooms": "_room", "_ws": "_w"})
    big = lambda c: F.col(c).cast("decimal(19,0)")
    # Whether a source is full when all before it are: its room against its share of what they leave.
    full = big("_room") * (weight_sum - big("_ws") + big("_w")) <= (total - big("_rooms") + big("_room")) * big("_w")
    marked = stored(summed.withColumn("_full", full), "source-levels")
    used, used_weight = marked.where("_full").agg(F.coalesce(F.sum("_room"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    share = F.col("_w") * float(total - used) / float(max(1, weight_sum - used_weight))
    return marked.select("source", "source_size", F.when(F.col("_full"), F.col("_room").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """Adds source_size, target and copies to `docs` (doc_id, source, size, and any other columns, which stay).

    Every document of a source has the same expected copies, target / source_size. Documents stand in the order of size, then of a
    hash of seed and id, so the sizes taken from a source miss its target by less than its largest document, and no document has more
    than `most` copies. The offset is a hash of seed and source. The same rows give the same copies, whatever their order; rows equal
    in source, size and id share theirs in any order. Null source: a source of its own, the last; null id: like an empty one; null
    size: 0. A source whose sizes are all 0 has the target 0 and no copies. An empty table stays empty. Columns of docs named like the
    new ones are replaced; other names cannot clash.

    Documents are placed by ranges of the order, so a source may hold any share of all rows.
    """
    given = [c for c in docs.columns if c.lower() not in ("source_size", "target", "copies")]
    keyed = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("given"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), keyed.alias("key"))
    rows = stored(rows, "sizes")
    targets = stored(source_targets(rows.select("source", "size"), weights, most), "targets")
    placed = numbered(rows, ["size", "key"], "at", within=["source"])
    same = F.col("source").eqNullSafe(F.col("of"))
    placed = placed.join(targets.withColumnRenamed("source", "of"), same)
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("."), "source"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name)), 1, 8), 16, 10).cast("decimal(19,0)")
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size").cast("double")) * PART)).otherwise(0).cast("decimal(14,0)")
    whole = lambda k: F.expr(f"(cast(at + {k} AS decimal(19,0)) * step + offset) div cast({PART} AS decimal(11,0))")
    counted = placed.withColumns({"step": step, "offset": offset}).withColumn("copies", whole(1) - whole(0))
    return counted.select("given.*", "source_size", "target", "copies")


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix_sources() as often as its copies say, with `copy` from 0. Rows without copies are absent."""
    return mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it; nulls and repeats as in mix_sources."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


OP12_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+'))::BIGINT AS size, md5('0/' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sources
), levels AS (
  SELECT *, 3 * source_size AS room, sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER earlier, 0) AS rooms, coalesce(sum(w) OVER earlier, 0) AS ws FROM weighed
  WINDOW earlier AS (ORDER BY 3 * source_size / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, room::HUGEINT * (weights - ws)::HUGEINT <= (total - rooms)::HUGEINT * w AS is_full FROM levels
), used AS (
  SELECT coalesce(sum(room) FILTER (WHERE is_full), 0) AS used, coalesce(sum(w) FILTER (WHERE is_full), 0) AS used_w FROM marked
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN room::DOUBLE ELSE w * (total - used)::DOUBLE / (weights - used_w)::DOUBLE END AS target FROM marked, used
), placed AS (
  SELECT s.*, source_size, target, row_number() OVER (PARTITION BY s.source ORDER BY size, key) - 1 AS nth,
    CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE * {PART}) ELSE 0 END::HUGEINT AS step,
    ('0x' || substr(md5('0/' || CASE WHEN s.source IS NULL THEN '' ELSE '.' || s.source END), 1, 8))::HUGEINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT *, (((nth + 1)::HUGEINT * step + start) // {PART} - (nth::HUGEINT * step + start) // {PART})::BIGINT AS copies FROM placed
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM mixed
"""
