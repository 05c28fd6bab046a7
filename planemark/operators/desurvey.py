"""Hole paths by minimum curvature: survey stations and sample depths of a hole in one ordered window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..sources.store import written
from .ordering import numbered


def stations(collars: DataFrame, surveys: DataFrame) -> DataFrame:
    """(HoleID, Depth_m, and the direction dx, dy, dz), one row a depth; holes whose first station lies below 0 get the collar's dip
    and azimuth at depth 0. Of stations at one depth the steepest dip, then the smallest azimuth counts."""
    given = surveys.select("HoleID", "Depth_m", "Dip", "Azimuth").dropna()
    firsts = given.groupBy("HoleID").agg(F.min("Depth_m").alias("first"))
    if {"Dip", "Azimuth"} <= set(collars.columns):
        at_collar = collars.join(firsts, "HoleID", "left").where("first IS NULL OR first > 0")
        given = given.unionByName(at_collar.select("HoleID", F.lit(0.0).alias("Depth_m"), "Dip", "Azimuth"))
    elif not collars.join(firsts, "HoleID", "left").where("first IS NULL OR first > 0").isEmpty():
        raise ValueError("collars need Dip and Azimuth, as some holes have no station at their collar")
    one = given.groupBy("HoleID", "Depth_m").agg(F.min(F.struct("Dip", "Azimuth")).alias("a"))
    x, y, z = v.direction("a.Dip", "a.Azimuth")
    return one.select("HoleID", "Depth_m", v.col(x).alias("dx"), v.col(y).alias("dy"), v.col(z).alias("dz"))


def paths(collars: DataFrame, surveys: DataFrame, depths: DataFrame) -> DataFrame:
    """(HoleID, Depth_m, X, Y, Z, ux, uy, uz) at every station and every depth of `depths` (HoleID, Depth_m).

    Directions are interpolated between stations and made unit vectors; beyond the last station its direction goes on. The collar
    is at the smallest depth of the hole.
    """
    at = stations(collars, surveys)
    hole = Window.partitionBy("HoleID").orderBy("Depth_m")
    given = ("Depth_m", "dx", "dy", "dz")
    # A station brings the next one of its hole, so that all windows over the hole's depths share one order.
    at = at.select("HoleID", *given, *(F.lead(c).over(hole).alias(f"next_{c}") for c in given))
    none = F.lit(None).cast("double")
    asked = depths.select("HoleID", F.col("Depth_m").cast("double").alias("Depth_m")).dropna()
    rows = asked.select("HoleID", "Depth_m", *(none.alias(c) for c in at.columns[2:])).unionByName(at)
    rows = rows.groupBy("HoleID", "Depth_m").agg(*(F.max(c).alias(c) for c in at.columns[2:]))
    station = F.when(F.col("dx").isNotNull(), F.struct(*at.columns[1:]))
    upto, whole = hole.rowsBetween(Window.unboundedPreceding, Window.currentRow), hole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("HoleID", "Depth_m", F.last(station, True).over(upto).alias("_last"), F.first(station, True).over(whole).alias("_first"))
    a = lambda c: F.coalesce(F.col(f"_last.{c}"), F.col(f"_first.{c}"))
    b = lambda c: F.coalesce(F.col(f"_last.next_{c}"), a(c))
    gap = b("Depth_m") - a("Depth_m")
    share = F.when(gap > 0, (F.col("Depth_m") - a("Depth_m")) / F.when(gap > 0, gap).otherwise(1.0)).otherwise(0.0)
    rows = rows.withColumn("_t", share).select("HoleID", "Depth_m", *((a(c) + F.col("_t") * (b(c) - a(c))).alias(f"_{c}") for c in ("dx", "dy", "dz")))
    rows = rows.select("HoleID", "Depth_m", *(v.col(e).alias(c) for c, e in zip(("ux", "uy", "uz"), v.unit(("_dx", "_dy", "_dz")), strict=True)))
    rows = rows.withColumns({f"_{c}": F.lag(c).over(hole) for c in ("Depth_m", "ux", "uy", "uz")})
    bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ux") * F.col("_ux") + F.col("uy") * F.col("_uy") + F.col("uz") * F.col("_uz"))))
    rows = rows.withColumn("_bend", bend)
    factor = F.when(F.col("_bend") < 1e-12, 1.0).otherwise(2.0 / F.when(F.col("_bend") < 1e-12, 1.0).otherwise(F.col("_bend")) * F.tan(F.col("_bend") / 2))
    rows = rows.withColumn("_half", 0.5 * (F.col("Depth_m") - F.col("_Depth_m")) * factor)
    moved = {c: F.sum(F.coalesce(F.col("_half") * (F.col(u) + F.col(f"_{u}")), F.lit(0.0))).over(hole.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for c, u in (("X", "ux"), ("Y", "uy"), ("Z", "uz"))}
    rows = rows.withColumns(moved)
    start = collars.select("HoleID", "Easting", "Northing", "Elevation")
    joined = rows.join(start, "HoleID")
    return joined.select("HoleID", "Depth_m", (F.col("Easting") + F.col("X")).alias("X"), (F.col("Northing") + F.col("Y")).alias("Y"), (F.col("Elevation") + F.col("Z")).alias("Z"), "ux", "uy", "uz")


def unique_collars(collars: DataFrame) -> DataFrame:
    """collars, which must have one row a hole."""
    twice = collars.groupBy("HoleID").count().where("count > 1").select("HoleID").head(5)
    if twice:
        raise ValueError(f"holes with more than one collar: {[r[0] for r in twice]}")
    return collars


def desurveyed(samples: DataFrame, collars: DataFrame, surveys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples as from placed(), and the paths. src_index, if samples do not bring one, numbers them by hole, from and to; one that they
    bring must tell them apart."""
    collars = unique_collars(collars)
    samples = with_src_index(samples)
    path = written(paths(collars, surveys, all_depths(samples)), "paths")
    return placed(samples, collars, path), path


def all_depths(samples: DataFrame) -> DataFrame:
    """(HoleID, Depth_m): where samples begin, end and have their middles."""
    return samples.select("HoleID", F.explode(F.array("From_m", "To_m", "mid_m")).alias("Depth_m"))


def placed(samples: DataFrame, collars: DataFrame, path: DataFrame) -> DataFrame:
    """Samples of holes that have a collar, with from_, to_ and mid_ x, y, z, the direction at the middle and collar columns.

    Every sample is sought in the paths by its three depths at once, in one join, and its rows are put side by side again.
    """
    carried = [c for c in ("Property", "Prospect", "HoleType") if c in collars.columns and c not in samples.columns]
    whole = samples.join(collars.select("HoleID", *carried, F.col("Length_m").alias("hole_length_m")), "HoleID")
    given = F.struct(*(F.col(f"`{c}`") for c in whole.columns))
    # The sample itself goes with one of its depths.
    roles = F.array(*(F.struct(F.lit(k).alias("_role"), F.col(c).alias("Depth_m"), (given if k == "mid" else F.lit(None).cast(whole.select(given.alias("g")).schema["g"].dataType)).alias("_given")) for k, c in (("from", "From_m"), ("to", "To_m"), ("mid", "mid_m"))))
    # The depths were copied, not computed anew, so they are equal to the last bit.
    found = whole.select("HoleID", F.col("src_index").alias("_row"), F.inline(roles)).join(path, ["HoleID", "Depth_m"], "left")
    at = lambda role, c: F.max(F.when(F.col("_role") == role, F.col(c)))
    places = [at(k, c).alias(f"{k}_{c.lower()}") for k in ("from", "to", "mid") for c in "XYZ"] + [at("mid", c).alias(c) for c in ("ux", "uy", "uz")]
    out = found.groupBy("_row").agg(F.first("_given", ignorenulls=True).alias("_given"), *places)
    return out.select("_given.*", *(c for c in out.columns if c not in ("_row", "_given")))


def with_src_index(df: DataFrame) -> DataFrame:
    """df with src_index, from 0 in the order of hole and depths; no task orders all rows or holes."""
    return df if "src_index" in df.columns else numbered(df, ["HoleID", "From_m", "To_m"], "src_index")


def hole_traces(points: DataFrame) -> DataFrame:
    """(HoleID, trace): the middles of each hole's samples in order of depth."""
    at = F.struct(F.col("mid_m").alias("depth"), F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), F.col("mid_z").alias("z"))
    return points.groupBy("HoleID").agg(F.array_sort(F.collect_list(at)).alias("trace"))
