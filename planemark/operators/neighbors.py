"""The neighbourhood graph: pairs of samples within a radius, and sums over them.

The pairs are rarely kept. Samples are dealt by grid cells, each to its own and to those it lies near, so that all neighbours of a cell's
samples are in one group: sums over neighbours are made there in arrays, and only samples are exchanged, some five rows for each.
Cells with very many samples around them go by an equi-join on cells in blocks. Declustering multiplies all weights of a (sample, other
hole) by one factor, so there sums over a sample's neighbours are sums over its holes of factor times sums over the hole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.matrices import SIX
from ..sources.store import send_package, written
from .ordering import quantiles_of

FLOOR = 1e-6


def nodes(active: DataFrame) -> DataFrame:
    """What the graph needs of the active samples: i, hole, x, y, z, s (score), len (interval)."""
    return active.select(
        F.col("src_index").alias("i"), F.col("HoleID").alias("hole"), F.col("mid_x").alias("x"), F.col("mid_y").alias("y"),
        F.col("mid_z").alias("z"), F.col("min_score").alias("s"), F.col("interval_m").alias("len"),
    ).where("hole IS NOT NULL")


#: Points of one cell that meet others in one task, and points around it that meet them there. Cells with more are cut into blocks.
DENSE, AROUND = 4096, 1 << 17
#: Up to so many dense cells, some 50 bytes each, are broadcast; more meet the points in a shuffle.
BROADCAST_CELLS = 200_000
CELL = ("_cx", "_cy", "_cz")
_STEPS = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def _cells(df: DataFrame, place: tuple[str, str, str], radius: float) -> DataFrame:
    # A little wider than the radius, so that rounding never puts a pair two cells apart.
    return df.withColumns({c: F.floor(F.col(p) / (radius * (1 + 1e-9))).cast("long") for c, p in zip(CELL, place, strict=True)})


def _around(cells: DataFrame, steps: list[tuple[int, int, int]], own: str = "_own") -> DataFrame:
    """Each row once for every step from its cell; `own` marks the one that stays."""
    given = [c for c in cells.columns if c not in CELL]
    to = F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(CELL, step, strict=True)), F.lit(step == (0, 0, 0)).alias(own)) for step in steps))
    return cells.select(*given, F.inline(to))


def _blocks(left: DataFrame, right: DataFrame, steps: list[tuple[int, int, int]], dense: int, around: int) -> DataFrame | None:
    """(cell, _ka, _kb): into how many blocks the points of a cell, and those that come to it, are cut; cells that are cut alone. None if
    there are none."""
    come = _around(right.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_b")), steps).groupBy(*CELL).agg(F.sum("_b").alias("_b"))
    return _cuts(left, come, dense, around)


def _cuts(left: DataFrame, come: DataFrame, dense: int, around: int) -> DataFrame | None:
    here = left.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_a"))
    cut = here.join(come, list(CELL)).where((F.col("_a") > dense) | (F.col("_b") > around))
    if cut.isEmpty():
        return None
    table = written(cut.select(*CELL, F.ceil(F.col("_a") / dense).cast("int").alias("_ka"), F.ceil(F.col("_b") / around).cast("int").alias("_kb")), "dense-cells")
    return F.broadcast(table) if table.count() <= BROADCAST_CELLS else table


def _in_blocks(df: DataFrame, cut: DataFrame, mine: str, theirs: str, block: str, other: str) -> DataFrame:
    """Rows with their own block in a cut cell, once for each block of the other side."""
    df = df.join(cut, list(CELL), "left")
    spread = F.pmod(F.xxhash64(*(c for c in df.columns if c not in (*CELL, "_ka", "_kb"))), F.coalesce(F.col(mine), F.lit(1))).cast("int")
    return df.withColumn(block, spread).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(theirs), F.lit(1)) - 1))).drop("_ka", "_kb")


def near(a: DataFrame, b: DataFrame, radius: float, same: bool = False, dense: int | None = None, around: int | None = None) -> DataFrame:
    """All columns of a (x, y, z, ..) and b (xj, yj, zj, ..) for pairs at most radius apart, with dx, dy, dz (b - a) and d2.

    Space is cut into cubes with sides of the radius; b goes to the 27 cubes around its own, a to its own, and cubes are the key. With
    `same`, a and b are the same points, numbered i and j: b goes to its own and 13 other cubes and each pair comes once, as i < j or in
    some other order. A cube with more than `dense` points of a, or to which more than `around` come, is cut into blocks that meet one
    another in tasks of their own.
    """
    steps = [s for s in _STEPS if s >= (0, 0, 0)] if same else _STEPS
    left, right = _cells(a, ("x", "y", "z"), radius), _cells(b, ("xj", "yj", "zj"), radius)
    # The same points have the same counts, which Spark then makes once.
    cut = _blocks(left, left if same else right, steps, dense or DENSE, around or AROUND)
    right, keys = _around(right, steps), list(CELL)
    if cut is not None:
        left, right = _in_blocks(left, cut, "_ka", "_kb", "_block_a", "_block_b"), _in_blocks(right, cut, "_kb", "_ka", "_block_b", "_block_a")
        keys += ["_block_a", "_block_b"]
    both = right.join(left, keys)
    if same:
        both = both.where("NOT _own OR i < j")
    both = both.drop(*keys, "_own").withColumns({f"d{c}": F.col(f"{c}j") - F.col(c) for c in "xyz"})
    return both.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("d2") <= radius * radius)


#: Sides of the cells in which sums are made, in radii, and pairs of samples that a task holds at once: so many doubles stay in a core's cache.
SIDE, AT_ONCE = 1.5, 1 << 17
#: Sides, in radii, of the cubes whose samples look for their neighbours together.
CUBE = 1.0
HOME = ("_hx", "_hy", "_hz")


def _dealt(n: DataFrame, radius: float, of: DataFrame | None = None, side: float | None = None) -> DataFrame:
    """n with each row in its own cell (_own) and in those of which some point is within the radius of it. of: whose cells these are, if not
    those of n."""
    side, reach = side or SIDE * radius, radius * (1 + 1e-6)
    low, high = ((n if of is None else of).agg(*(f(c).alias(c) for c in "xyz")).first() for f in (F.min, F.max))
    if low["x"] is None or low["y"] is None or low["z"] is None:
        low = high = {"x": 0.0, "y": 0.0, "z": 0.0}
    out, apart = n, F.lit(0.0)
    for c, h in zip("xyz", HOME, strict=True):
        at = lambda v: F.floor(v / side)
        # Of the cells those between the outermost samples.
        first, last = F.greatest(at(F.col(c) - reach), at(F.lit(low[c]))), F.least(at(F.col(c) + reach), at(F.lit(high[c])))
        out = out.withColumn(h, F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last)))))
        off = F.greatest(F.col(h) * side - F.col(c), F.col(c) - (F.col(h) + 1) * side, F.lit(0.0))
        apart = apart + off * off
    own = F.lit(True)
    for c, h in zip("xyz", HOME, strict=True):
        own = own & (F.col(h) == F.floor(F.col(c) / side))
    return out.where(apart <= reach * reach).withColumn("_own", own)


def in_cubes(place: np.ndarray, rows: np.ndarray, radius: float, at_once: int, cube: float = CUBE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of `rows`, ascending, and all rows of `place` (x, y, z) that may be within the radius of them, ascending too; at most `at_once` pairs at a
    time, if one row has no more. Rows without a finite place have no neighbours and are left out."""
    rows = rows[np.isfinite(place[rows]).all(axis=1)]
    if not len(rows):
        return
    if len(rows) * len(place) <= at_once:
        yield rows, np.arange(len(place))
        return
    at = np.floor(place[rows] / (radius * cube))
    # Lexicographic, and ascending within a cube.
    order = np.lexsort(at.T)
    rows, at, reach = rows[order], at[order], radius * (1 + 1e-6)
    columns = [np.ascontiguousarray(c) for c in place.T]
    for mine in np.split(rows, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1):
        low, high = place[mine].min(axis=0) - reach, place[mine].max(axis=0) + reach
        some = (columns[0] >= low[0]) & (columns[0] <= high[0])
        for c, a, b in zip(columns[1:], low[1:], high[1:], strict=True):
            some &= (c >= a) & (c <= b)
        near_by = np.flatnonzero(some)
        step = max(1, at_once // max(1, len(near_by)))
        for k in range(0, len(mine), step):
            yield mine[k : k + step], near_by


def distances(place: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of rows (lines) and others (columns), summed in the order of x, y, z."""
    d2 = place[others, 0] - place[rows, 0][:, None]
    d2 *= d2
    for c in (1, 2):
        d = place[others, c] - place[rows, c][:, None]
        d *= d
        d2 += d
    return d2


def in_cells(n: DataFrame, radius: float, exclude_same_hole: bool, schema: StructType, body: Callable[..., dict[str, Any]], around: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What body makes of all neighbours of some samples, for all samples of n (i, hole, x, y, z, others) but those whose cell more than
    `around` samples lie near; and these, or None if there are none.

    body(given, here, there, d2) -> columns by the names of schema. given: the group's columns as arrays, `hole` as numbers, and `names`,
    a function from numbers of holes to their names, and `ids`, one from rows to their i; here and there: rows of the samples and of their
    neighbours, ordered by sample and then by the neighbour's hole.
    """
    send_package(n.sparkSession)
    dealt = _dealt(n, radius)
    counts = dealt.groupBy(*HOME).agg(F.count(F.lit(1)).alias("_k"), F.max("_own").alias("_some"))
    dense = counts.where(F.col("_some") & (F.col("_k") > (around or AROUND))).select(*HOME)
    rest = None
    if not dense.isEmpty():
        dense = written(dense, "dense-cells")
        rest = written(dealt.where("_own").join(dense, list(HOME), "left_semi").select(*n.columns), "dense")
        dealt = dealt.join(dense, list(HOME), "left_anti")
    limit, at_once = radius * radius, AT_ONCE

    def task(group: pa.Table) -> pa.Table:
        holes = group["hole"].combine_chunks().dictionary_encode()
        order = np.argsort(holes.indices.to_numpy(), kind="stable")
        ids = group["i"].combine_chunks().take(pa.array(order))
        given: dict[str, Any] = {c: group[c].to_numpy()[order] for c in group.column_names if c not in ("i", "hole", *HOME)}
        given |= {"hole": holes.indices.to_numpy()[order], "names": lambda k: holes.dictionary.take(pa.array(k)), "ids": lambda k: ids.take(pa.array(k))}
        same = ids.dictionary_encode().indices.to_numpy()
        place, hole, made = np.stack([given[c] for c in "xyz"], 1), given["hole"], []
        for rows, others in in_cubes(place, np.flatnonzero(given["_own"]), radius, at_once):
            d2 = distances(place, rows, others)
            near_by = (d2 <= limit) & (d2 > 0)
            if exclude_same_hole:
                near_by &= hole[others] != hole[rows, None]
            line, column = np.nonzero(near_by)
            here, there, d2 = rows[line], others[column], d2[line, column]
            other = same[here] != same[there]
            if not other.all():
                here, there, d2 = here[other], there[other], d2[other]
            if len(d2):
                made.append(pa.table(body(given, here, there, d2)))
        return pa.concat_tables(made) if made else pa.table({c: [] for c in names})

    names, arrow = schema.fieldNames(), to_arrow_schema(schema)
    # A number of partitions that is asked for stays: the work goes with the pairs, not with the bytes.
    parts = int(n.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(parts, *HOME).groupBy(*HOME).applyInArrow(lambda group: task(group).select(names).cast(arrow), schema)
    return out, rest


def touched(points: DataFrame, samples: DataFrame, radius: float, dense: int | None = None, around: int | None = None) -> DataFrame:
    """The rows of samples (x, y, z, ..) with `surfaces`, the different numbers `surface` of the points (surface, x, y, z) within the radius.

    Samples are dealt by cells, points to the cells that they lie near: no pair leaves its task. Cells with more than `dense` samples, or
    near which more than `around` points lie, are cut into blocks.
    """
    renamed = dict(zip(HOME, CELL, strict=True))
    side = SIDE * radius
    here = samples.withColumns({c: F.floor(F.col(k) / side) for c, k in zip(CELL, "xyz", strict=True)})
    come = _dealt(points.select("surface", "x", "y", "z"), radius, samples).drop("_own").withColumnsRenamed(renamed)
    cut, keys = _cuts(here, come.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_b")), dense or DENSE, around or AROUND), list(CELL)
    if cut is not None:
        here, come = _in_blocks(here, cut, "_ka", "_kb", "_block_a", "_block_b"), _in_blocks(come, cut, "_kb", "_ka", "_block_b", "_block_a")
        keys += ["_block_a", "_block_b"]
    schema = StructType([*samples.schema.fields]).add("surfaces", ArrayType(IntegerType()))
    names, arrow, limit, at_once = samples.columns, to_arrow_schema(schema), radius * radius, AT_ONCE

    def task(own: pa.Table, near_by: pa.Table) -> pa.Table:
        near_by = near_by.sort_by("surface")
        x, y, z, surface = (near_by[c].to_numpy() for c in ("x", "y", "z", "surface"))
        starts = np.flatnonzero(np.r_[True, surface[1:] != surface[:-1]]) if len(surface) else np.zeros(0, np.int64)
        found, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        ox, oy, oz = (own[c].to_numpy()[:, None] for c in "xyz")
        step = max(1, at_once // max(1, len(x)))
        for k in range(0, len(ox), step):
            dx, dy, dz = x - ox[k : k + step], y - oy[k : k + step], z - oz[k : k + step]
            close = dx * dx + dy * dy + dz * dz <= limit
            some = np.logical_or.reduceat(close, starts, axis=1) if len(starts) else close
            found.append(surface[starts][np.nonzero(some)[1]])
            counts.append(some.sum(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
        return own.select(names).append_column("surfaces", lists).cast(arrow)

    out = here.groupBy(*keys).cogroup(come.groupBy(*keys)).applyInArrow(task, schema)
    if cut is None:
        return out
    # A sample of a cut cell stands in it once for each block of points.
    return out.groupBy(*names).agg(F.array_distinct(F.flatten(F.collect_list("surfaces"))).alias("surfaces"))


def edges(n: DataFrame, radius: float, exclude_same_hole: bool = True, of: DataFrame | None = None) -> DataFrame:
    """Directed pairs (i, hole, s, j, holej, sj, lenj, dx, dy, dz, d2) of different places, as a rule of different holes. Each pair is found
    once and mirrored. of: some rows of n, whose pairs alone are asked for."""
    other = n.select(*(F.col(c).alias(f"{c}j") for c in ("hole", "x", "y", "z", "s", "len")), F.col("i").alias("j"))
    if of is not None:
        pairs = near(of, other, radius).where("i <> j AND d2 > 0")
        return (pairs.where("hole <> holej") if exclude_same_hole else pairs).select("i", "hole", "s", "j", "holej", "sj", "lenj", "dx", "dy", "dz", "d2")
    pairs = near(n, other, radius, same=True).where("i <> j AND d2 > 0")
    if exclude_same_hole:
        pairs = pairs.where("hole <> holej")
    out = ("i", "hole", "s", "j", "holej", "sj", "lenj", "dx", "dy", "dz", "d2")
    turned = {"i": "j", "hole": "holej", "s": "sj", "j": "i", "holej": "hole", "sj": "s", "lenj": "len"}
    there = F.struct(*(F.col(c).alias(c) for c in out))
    back = F.struct(*((-F.col(c) if c in ("dx", "dy", "dz") else F.col(turned.get(c, c))).alias(c) for c in out))
    return pairs.select(F.inline(F.array(there, back)))


def least_score(n: DataFrame) -> float:
    return n.agg(F.min("s")).first()[0] or 0.0


def weighted(e: DataFrame, floor: float, sigma: float, graded: bool = True) -> DataFrame:
    """Adds near_term and w0, the weight before declustering. floor: the least score of all active samples."""
    e = e.withColumn("near_term", F.exp(-F.col("d2") / (2 * sigma * sigma)))
    grade = F.greatest(F.col("sj") - floor + FLOOR, F.lit(FLOOR)) if graded else F.lit(1.0)
    return e.withColumn("w0", grade * F.col("near_term") * F.greatest("lenj", F.lit(0.1)))


def edge_weights(n: DataFrame, cfg: dict[str, Any], graded: bool = True) -> DataFrame:
    """The pairs with their final weights w, for what needs them one by one. They are written before declustering, so that the pairs of
    the radius are found once."""
    e = weighted(edges(n, cfg["radius_m"], cfg["exclude_same_hole_neighbors"]), least_score(n), cfg["distance_sigma_m"], graded)
    e = written(e, "edges") if cfg["decluster_by_hole"] else e
    if not cfg["decluster_by_hole"]:
        return e.withColumn("w", F.col("w0"))
    factors = e.groupBy("i", "holej").agg(_factor().alias("_f"))
    return e.join(factors, ["i", "holej"]).withColumn("w", F.col("w0") * F.col("_f")).drop("_f")


def _factor() -> Column:
    total = F.sum("w0")
    return F.max("near_term") / F.when(total > 0, total).otherwise(1.0)


def _moments(lsq: bool) -> dict[str, Column]:
    d = {c: F.col(f"d{c}") for c in "xyz"}
    out = {"m0": F.lit(1.0)}
    if not lsq:
        out |= {f"m{c}": d[c] for c in "xyz"}
        out |= {f"m{k}": d[k[0]] * d[k[1]] for k in SIX}
    else:
        delta = (F.col("sj") - F.col("s")) / F.sqrt("d2")
        out |= {f"a{k}": d[k[0]] * d[k[1]] / F.col("d2") for k in SIX}
        out |= {f"b{c}": delta * d[c] / F.sqrt("d2") for c in "xyz"}
        out["c"] = delta * delta
    return out


def _joined_moments(n: DataFrame, of: DataFrame, cfg: dict[str, Any], graded: bool, lsq: bool, split: Column | None, floor: float) -> DataFrame:
    """moments() of the rows `of` n, from pairs that meet by cells in blocks."""
    e = weighted(edges(n, cfg["radius_m"], cfg["exclude_same_hole_neighbors"], of), floor, cfg["distance_sigma_m"], graded)
    terms = _moments(lsq)
    by_hole = e.groupBy("i", "holej").agg(
        F.count(F.lit(1)).alias("n"), F.max("near_term").alias("top"), F.sum("w0").alias("_m0"), *(F.sum(F.col("w0") * t).alias(f"_{k}") for k, t in terms.items() if k != "m0")
    )
    factor = F.col("top") / F.when(F.col("_m0") > 0, F.col("_m0")).otherwise(1.0) if cfg["decluster_by_hole"] else F.lit(1.0)
    keys = ["i"]
    if split is not None:
        by_hole = by_hole.withColumn("half", split)
        keys.append("half")
    by_hole = by_hole.withColumn("_f", factor)
    return by_hole.groupBy(*keys).agg(F.sum("n").alias("local_n"), F.count(F.lit(1)).alias("local_holes"), *(F.sum(F.col("_f") * F.col(f"_{k}")).alias(k) for k in terms))


def weigher(cfg: dict[str, Any], graded: bool, floor: float) -> Callable[..., tuple[Any, ...]]:
    """A function from a task's pairs to starts of (sample, other hole) among them, and the weights before and after declustering."""
    wide, least, decluster = 2 * cfg["distance_sigma_m"] ** 2, FLOOR, cfg["decluster_by_hole"]

    def weigh(given: dict[str, Any], here: np.ndarray, there: np.ndarray, d2: np.ndarray) -> tuple[Any, ...]:
        hole = given["hole"][there]
        starts = np.flatnonzero(np.r_[True, (here[1:] != here[:-1]) | (hole[1:] != hole[:-1])])
        close = np.exp(-d2 / wide)
        each = np.fmax(given["len"], 0.1)
        w0 = close * (np.maximum(given["s"] - floor + least, least) * each if graded else each)[there]
        if not decluster:
            return starts, w0, w0
        total = np.add.reduceat(w0, starts)
        factor = np.maximum.reduceat(close, starts) / np.where(total > 0, total, 1.0)
        return starts, w0, w0 * np.repeat(factor, np.diff(np.r_[starts, len(d2)]))

    return weigh


def moments(n: DataFrame, cfg: dict[str, Any], graded: bool = True, lsq: bool = False, split: Column | None = None, floor: float | None = None, around: int | None = None) -> DataFrame:
    """One row for each i (and each value of split, a function of holej): local_n, local_holes, m0 (sum of weights), and sums of
    w times offsets and their products, or with lsq of w times what the normal equations need. floor: the least score, if not that of n."""
    n = written(n, "nodes")
    least = least_score(n) if floor is None else floor
    halves = n if split is None else n.withColumn("holej", F.col("hole")).withColumn("half", split).drop("holej")
    six, weigh, by_half = SIX, weigher(cfg, graded, least), split is not None

    def body(given: dict[str, Any], here: np.ndarray, there: np.ndarray, d2: np.ndarray) -> dict[str, Any]:
        out: list[dict[str, Any]] = []
        for half in np.unique(given["half"][there]) if by_half else (None,):
            some = slice(None) if half is None else given["half"][there] == half
            h, t, q = here[some], there[some], d2[some]
            starts, _, w = weigh(given, h, t, q)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            d = {c: given[c][t] - given[c][h] for c in "xyz"}
            terms = {"m0": w}
            if not lsq:
                terms |= {f"m{c}": w * d[c] for c in "xyz"} | {f"m{k}": w * (d[k[0]] * d[k[1]]) for k in six}
            else:
                size = np.sqrt(q)
                delta = (given["s"][t] - given["s"][h]) / size
                terms |= {f"a{k}": w * (d[k[0]] * d[k[1]] / q) for k in six} | {f"b{c}": w * (delta * d[c] / size) for c in "xyz"} | {"c": w * (delta * delta)}
            one = {"i": h[first], "local_n": np.diff(np.r_[first, len(h)]), "local_holes": np.diff(np.searchsorted(starts, np.r_[first, len(h)]))}
            one |= {k: np.add.reduceat(v, first) for k, v in terms.items()}
            out.append(one if half is None else one | {"half": np.full(len(first), half)})
        whole = {k: np.concatenate([o[k] for o in out]) for k in out[0]}
        return whole | {"i": given["ids"](whole["i"])}

    schema = StructType([halves.schema["i"]])
    if by_half:
        schema = StructType([*schema.fields, halves.schema["half"]])
    schema = schema.add("local_n", "long").add("local_holes", "long")
    for k in _moments(lsq):
        schema = schema.add(k, "double")
    made, rest = in_cells(halves, cfg["radius_m"], cfg["exclude_same_hole_neighbors"], schema, body, around)
    if rest is None:
        return made
    return made.unionByName(_joined_moments(n, rest.select(*n.columns), cfg, graded, lsq, split, least))


def over_halves(m: DataFrame) -> DataFrame:
    """moments() of all neighbours from those by half: a hole lies wholly in one, so numbers and sums add up."""
    return m.groupBy("i").agg(*(F.sum(c).alias(c) for c in m.columns if c not in ("i", "half")))


def hole_weights(n: DataFrame, cfg: dict[str, Any], graded: bool = True, around: int | None = None) -> DataFrame:
    """(i, holej, n, sum_w, max_w): number, sum and greatest of the final weights of a sample's neighbours in another hole."""
    n = written(n, "nodes")
    floor = least_score(n)
    weigh = weigher(cfg, graded, floor)

    def body(given: dict[str, Any], here: np.ndarray, there: np.ndarray, d2: np.ndarray) -> dict[str, Any]:
        starts, _, w = weigh(given, here, there, d2)
        sums = {"n": np.diff(np.r_[starts, len(w)]), "sum_w": np.add.reduceat(w, starts), "max_w": np.maximum.reduceat(w, starts)}
        return {"i": given["ids"](here[starts]), "holej": given["names"](given["hole"][there[starts]])} | sums

    schema = StructType([n.schema["i"]]).add("holej", n.schema["hole"].dataType).add("n", "long").add("sum_w", "double").add("max_w", "double")
    made, rest = in_cells(n, cfg["radius_m"], cfg["exclude_same_hole_neighbors"], schema, body, around)
    if rest is None:
        return made
    e = weighted(edges(n, cfg["radius_m"], cfg["exclude_same_hole_neighbors"], rest), floor, cfg["distance_sigma_m"], graded)
    factor = _factor() if cfg["decluster_by_hole"] else F.lit(1.0)
    return made.unionByName(e.groupBy("i", "holej").agg(F.count(F.lit(1)).alias("n"), (F.sum("w0") * factor).alias("sum_w"), (F.max("w0") * factor).alias("max_w")))


def means_over(n: DataFrame, cfg: dict[str, Any], graded: bool = True, around: int | None = None) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A function of values (i and columns) that gives (i, _w and _<column>), sum of the final weights of a sample's neighbours that have
    values, and their weighted means. Pairs are found anew each time in the tasks, which is less than to read them back."""
    n = written(n, "nodes")
    floor = least_score(n)
    weigh = weigher(cfg, graded, floor)

    def means(values: DataFrame, columns: list[str]) -> DataFrame:
        with_values = written(n.join(values.select("i", F.lit(True).alias("_has"), *(F.col(c).alias(f"_{c}") for c in columns)), "i", "left").withColumn("_has", F.coalesce("_has", F.lit(False))), "values")

        def body(given: dict[str, Any], here: np.ndarray, there: np.ndarray, d2: np.ndarray) -> dict[str, Any]:
            _, _, w = weigh(given, here, there, d2)
            some = given["_has"][there].astype(bool)
            here, there, w = here[some], there[some], w[some]
            if not len(w):
                return {"i": given["ids"](here), "_w": w} | {f"_{c}": w for c in columns}
            first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            total = np.add.reduceat(w, first)
            least = np.where(total > 0, total, 1.0)
            return {"i": given["ids"](here[first]), "_w": total} | {f"_{c}": np.add.reduceat(w * given[f"_{c}"][there], first) / least for c in columns}

        schema = StructType([n.schema["i"]]).add("_w", "double")
        for c in columns:
            schema = schema.add(f"_{c}", "double")
        made, rest = in_cells(with_values, cfg["radius_m"], cfg["exclude_same_hole_neighbors"], schema, body, around)
        if rest is None:
            return made
        e = weighted(edges(n, cfg["radius_m"], cfg["exclude_same_hole_neighbors"], rest.select(*n.columns)), floor, cfg["distance_sigma_m"], graded)
        e = written(e, "edges")
        w = F.col("w0")
        if cfg["decluster_by_hole"]:
            e = e.join(e.groupBy("i", "holej").agg(_factor().alias("_f")), ["i", "holej"])
            w = w * F.col("_f")
        e = e.select("i", "j", w.alias("w")).join(values.select(F.col("i").alias("j"), *(F.col(c).alias(f"_{c}") for c in columns)), "j")
        total = F.sum("w")
        return made.unionByName(e.groupBy("i").agg(total.alias("_w"), *((F.sum(F.col("w") * F.col(f"_{c}")) / F.when(total > 0, total).otherwise(1.0)).alias(f"_{c}") for c in columns)))

    return means


def gate_diagnosis(n: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """One row: how many samples fail which gate, and what they have: medians, the tenth, the most."""
    e = edges(n, cfg["radius_m"], cfg["exclude_same_hole_neighbors"]).groupBy("i", "holej").agg(F.count(F.lit(1)).alias("k"))
    counts = e.groupBy("i").agg(F.sum("k").alias("local_n"), F.count(F.lit(1)).alias("local_holes"))
    all_ = written(n.select("i").join(counts, "i", "left").fillna(0), "counts")
    fails = lambda c, least: F.coalesce(F.sum(F.when(F.col(c) < least, 1).otherwise(0)), F.lit(0)).alias(f"failed_{c}")
    sums = all_.agg(F.count(F.lit(1)).alias("n_active"), F.max("local_n").alias("max_local_n"), fails("local_n", cfg["min_neighbors"]), fails("local_holes", cfg["min_holes"]))
    middle = quantiles_of(all_, {"median_local_n": ("local_n", 0.5), "p10_local_n": ("local_n", 0.1), "median_local_holes": ("local_holes", 0.5)})
    # Two tables of one row.
    return sums.join(F.broadcast(middle)).select("n_active", "median_local_n", "p10_local_n", "max_local_n", "failed_local_n", "median_local_holes", "failed_local_holes")
