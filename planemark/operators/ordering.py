"""Places, running sums and exact quantiles in an order of all rows, without a task that orders all of them.

Rows are dealt into ranges of the order and written with their range's number; of the ranges only counts and sums meet in one place,
one row a range. What comes out does not hang on where the ranges end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

RANGE = "_range_of_order"
Key = str | Column


def in_ranges(df: DataFrame, order: Sequence[Key]) -> DataFrame:
    """df in a written table, with the number of each row's range of `order`: rows that are equal in it share a range, and a later range
    holds later rows. As many ranges as the session has shuffle partitions, fewer if rows are few."""
    return written(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: Sequence[Key], sums: dict[str, Key], within: Sequence[str] = ()) -> DataFrame:
    """Adds for each of `sums` (name: a column) its sum over this row and all rows before it in `order`, among those alike in `within`.

    Rows that are equal in `order` come one after the other in any order, so whoever needs the same places again orders by a key.
    Nulls count as nothing. Columns of `within` may be null: nulls are alike. An empty table stays empty.
    """
    values = {f"_value_{k}": (F.col(c) if isinstance(c, str) else c) for k, c in sums.items()}
    ranged = in_ranges(df.withColumns(values), [*within, *order])
    totals = ranged.groupBy(RANGE, *within).agg(*(F.sum(v).alias(f"_total_{k}") for k, v in zip(sums, values, strict=True)))
    earlier = Window.partitionBy(*within).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range, and one more for each change of `within`.
    before = totals.select(F.col(RANGE).alias("_range"), *(F.col(w).alias(f"_within_{i}") for i, w in enumerate(within)), *(F.coalesce(F.sum(f"_total_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums))
    same = F.col(RANGE) == F.col("_range")
    for i, w in enumerate(within):
        same = same & F.col(w).eqNullSafe(F.col(f"_within_{i}"))
    here = Window.partitionBy(RANGE, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({f"_here_{k}": F.coalesce(F.sum(v).over(here), F.lit(0)) for k, v in zip(sums, values, strict=True)}).join(before, same)
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in sums), *((F.col(f"_before_{k}") + F.col(f"_here_{k}")).alias(k) for k in sums))


def numbered(df: DataFrame, order: Sequence[Key], out: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds `out`: each row's place in `order` from 0, among all rows or among those alike in `within`."""
    placed = running(df, order, {out: F.lit(1).cast("long")}, within)
    return placed.withColumn(out, F.col(out) - 1)


#: Values that quantiles() orders as they are. Of more it counts BINS parts of the interval that a place lies in, twice, and orders the rest.
MANY, BINS = 1_000_000, 4096
#: Places, one for each group and share, that are broadcast to the values.
BROADCAST_PLACES = 100_000


def _same(keys: Sequence[str], there: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}{there}"))
    return out


def _held(rows: DataFrame, places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values within each place's interval, with the place."""
    other = places.select(*(F.col(k).alias(f"{k}_") for k in keys), "_share", "_place", "_all", "_below", "_lo", "_hi")
    other = F.broadcast(other) if places.count() <= BROADCAST_PLACES else other
    return rows.where("_v IS NOT NULL").join(other, _same(keys, "_") & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop(*(f"{k}_" for k in keys))


def _narrowed(rows: DataFrame, places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The places with the interval of those parts that hold their neighbours, and the number of values below it: only counts meet."""
    # Halves, as a difference of two doubles may be too great for one; a part never falls as the value grows, whatever is rounded.
    half = lambda c: F.greatest(F.least(F.col(c), F.lit(1e308)), F.lit(-1e308)) / 2
    width = half("_hi") - half("_lo")
    part = F.when(width > 0, F.floor((half("_v") - half("_lo")) / width * BINS).cast("int")).otherwise(0).alias("_part")
    same = [*keys, "_share"]
    counts = _held(rows, places, keys).groupBy(*same, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *(F.first(c).alias(c) for c in ("_place", "_all", "_below")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_below", F.col("_below") + before).where((F.floor("_place") < F.col("_below") + F.col("_n")) & (F.ceil("_place") >= F.col("_below")))
    return counts.groupBy(*same).agg(F.first("_place").alias("_place"), F.first("_all").alias("_all"), F.min("_below").alias("_below"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], within: Sequence[str] = (), again: bool = False, many: int | None = None) -> DataFrame:
    """One row for each value of `within` (or one in all): the exact quantiles of `value`, between two neighbours in proportion.

    shares: name of a result and its share, 0 to 1. Nulls and NaN do not count; groups without any other value have null, and so has
    the one row of an empty table. again: df is cheap to read some times over; else its values are written, unless they are. Of more than
    `many` values only those near the wanted places are exchanged, counted and ordered over ranges.
    """
    if any(not 0 <= p <= 1 for p in shares.values()):
        raise ValueError(f"shares lie between 0 and 1: {shares}")
    keys = [f"_key_{i}" for i in range(len(within))]
    v = F.col(value).cast("double")
    rows = df.select(*(F.col(w).alias(k) for w, k in zip(within, keys, strict=True)), F.when(~F.isnan(v), v).alias("_v"))
    if not again and not hasattr(df, "_written_at"):
        rows = written(rows, "values")
    groups = written(rows.groupBy(*keys).agg(F.count("_v").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "groups")
    wanted = F.array(*(F.struct(F.lit(k).alias("_share"), (p * (F.col("_all") - 1)).alias("_place")) for k, p in shares.items()))
    places = written(groups.where("_all > 0").select(*keys, F.inline(wanted), "_all", F.lit(0).cast("long").alias("_below"), "_lo", "_hi"), "places")
    if (groups.agg(F.sum("_all")).first()[0] or 0) > (MANY if many is None else many):
        for _ in range(2):
            places = written(_narrowed(rows, places, keys), "places")
    same = [*keys, "_share"]
    counted = in_ranges(_held(rows, places, keys).groupBy(*same, "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_place").alias("_place"), F.first("_below").alias("_below")), [*same, "_v"])
    sizes = counted.groupBy(*same, RANGE).agg(F.sum("_n").alias("_size"), F.first("_place").alias("_place"), F.first("_below").alias("_below"))
    earlier = Window.partitionBy(*same).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    # Of the ranges those that hold the place's neighbours, counted from 0.
    near = sizes.where((F.floor("_place") < F.col("_before") + F.col("_size")) & (F.ceil("_place") >= F.col("_before")))
    chosen = near.select(F.col(RANGE).alias("_range"), *(F.col(k).alias(f"{k}_") for k in same), "_before")
    held = counted.join(chosen, _same(same, "_") & (F.col(RANGE) == F.col("_range"))).drop("_range", *(f"{k}_" for k in same))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*same, RANGE).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = held.withColumn("_upto", upto)

    def neighbour(place: Column) -> Column:
        return F.max(F.when((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")), F.col("_v")))

    found = held.groupBy(*same).agg(F.first("_place").alias("_place"), neighbour(F.floor("_place")).alias("_a"), neighbour(F.ceil("_place")).alias("_b"))
    found = found.withColumn("_found", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_place") - F.floor("_place")) * (F.col("_b") - F.col("_a"))))
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_share") == k, F.col("_found"))).alias(k) for k in shares))
    if not keys:
        return found
    return groups.select(*(F.col(k).alias(f"{k}_") for k in keys)).join(found, _same(keys, "_"), "left").select(*(F.col(f"{k}_").alias(w) for k, w in zip(keys, within, strict=True)), *shares)


def quantiles_of(df: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: for each name the quantile of a column and share, all in one pass over df."""
    of = sorted({c for c, _ in columns.values()})
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in of))).alias("x")).select("x.*")
    found = quantiles(long, "value", {f"q{i}": p for i, (_, p) in enumerate(columns.values())}, ["column"])
    return found.agg(*(F.max(F.when(F.col("column") == c, F.col(f"q{i}"))).alias(k) for i, (k, (c, _)) in enumerate(columns.items())))
