"""A folded deposit with known planes: holes in sections, survey stations, samples with grades around a folded shell.

Noise comes from keyed hashes of row numbers, so the tables are made on the executors and are alike for a seed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import settings
from ..functions import vectors as v
from ..operators.desurvey import paths

# The deposit's shape and drilling.
ORIGIN = (10000.0, 10000.0, 1000.0)
PARAMETERS = {
    "z0": 870.0, "amplitude": 80.0, "wavelength": 400.0, "plunge_deg": 10.0, "shell_thickness": 25.0,
    "n_sections": 8, "section_spacing": 100.0, "holes_per_section": 14, "hole_spacing": 80.0, "hole_length": 300.0,
    "collar_dip": -60.0, "sample_length": 1.5, "survey_interval": 30.0,
    "cu_background": 0.02, "cu_amplitude": 1.80, "au_background": 0.01, "au_amplitude": 2.20,
    "cu_noise": 0.25, "au_noise": 0.60, "shared_noise": 0.30,
}


@dataclass
class Deposit:
    samples: DataFrame
    collars: DataFrame
    surveys: DataFrame
    parameters: dict[str, Any]


def noise(seed: int, *keys: Any) -> Column:
    """A standard normal value by the keys (Box and Muller's transform of two hashes)."""
    cols = [F.lit(k) if isinstance(k, str | int) else k for k in keys]
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *cols), 11).cast("double") + 0.5) / 2.0**53 for k in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])


def _slope(p: dict[str, Any]) -> tuple[Column, float]:
    import math

    k = 2 * math.pi / p["wavelength"]
    return -p["amplitude"] * k * F.sin(k * (F.col("x") - ORIGIN[0])), -math.tan(math.radians(p["plunge_deg"]))


def surface(p: dict[str, Any]) -> Column:
    """Height of the shell's middle at columns x, y."""
    import math

    k = 2 * math.pi / p["wavelength"]
    return p["z0"] + p["amplitude"] * F.cos(k * (F.col("x") - ORIGIN[0])) - (F.col("y") - ORIGIN[1]) * math.tan(math.radians(p["plunge_deg"]))


def folded(points: DataFrame, **given: Any) -> DataFrame:
    """points (x, y, z and others) beside the folded shell: shell_distance (along its normal), shell_grade (as copper, without noise) and the
    plane that the fold has there, true_pole_x, _y, _z. An unknown parameter is a KeyError."""
    unknown = sorted(set(given) - set(PARAMETERS))
    if unknown:
        raise KeyError(f"no such parameters: {unknown}")
    p = PARAMETERS | given
    sx, sy = _slope(p)
    size = F.sqrt(1 + sx * sx + F.lit(sy * sy))
    away = (F.col("z") - surface(p)) / size
    grade = p["cu_background"] + p["cu_amplitude"] * F.exp(-0.5 * (away / p["shell_thickness"]) ** 2)
    return points.withColumns({"shell_distance": away, "shell_grade": grade, "true_pole_x": -sx / size, "true_pole_y": F.lit(-sy) / size, "true_pole_z": 1 / size})


def deposit(spark: SparkSession, seed: int = 0, **given: Any) -> Deposit:
    """An unknown parameter is a KeyError."""
    unknown = sorted(set(given) - set(PARAMETERS))
    if unknown:
        raise KeyError(f"no such parameters: {unknown}")
    p = PARAMETERS | given
    n = p["holes_per_section"]
    h = spark.range(p["n_sections"] * n).select("id", F.floor(F.col("id") / n).cast("int").alias("s"), (F.col("id") % n).cast("int").alias("k"))
    h = h.withColumn("HoleID", F.format_string("SYN-%02d-%02d", "s", "k"))
    z = lambda what: noise(seed, what, F.col("id"))
    h = h.withColumns({
        "Easting": F.round(ORIGIN[0] + F.col("k") * p["hole_spacing"] + 5 * z("e"), 2), "Northing": F.round(ORIGIN[1] + F.col("s") * p["section_spacing"] + 5 * z("n"), 2),
        "Elevation": F.round(ORIGIN[2] + 3 * z("z"), 2), "Length_m": F.round(p["hole_length"] + 15 * z("l"), 1),
        "Dip": F.round(p["collar_dip"] + 2 * z("d"), 2), "Azimuth": F.round(F.pmod(F.when(F.col("s") % 2 == 0, 90.0).otherwise(270.0) + 4 * z("a"), F.lit(360.0)), 2),
    })
    collars = h.select("HoleID", "Easting", "Northing", "Elevation", "Length_m", "Dip", "Azimuth", F.lit("Synthetic").alias("Property"), F.format_string("Section %02d", "s").alias("Prospect"))
    at = h.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("Length_m") / p["survey_interval"]).cast("int"))).alias("m"))
    # Wobbles add up along the hole.
    wander = lambda what, size: size * F.aggregate(F.transform(F.sequence(F.lit(0), F.col("m")), lambda i: noise(seed, what, F.col("id"), i)), F.lit(0.0), lambda a, x: a + x)
    part = F.col("m") * p["survey_interval"] / F.greatest(F.col("Length_m"), F.lit(1.0))
    surveys = at.select("HoleID", (F.col("m") * p["survey_interval"]).cast("double").alias("Depth_m"), F.round(F.col("Dip") + 5 * part + wander("wd", 0.25), 2).alias("Dip"), F.round(F.pmod(F.col("Azimuth") + 8 * part + wander("wa", 0.40), F.lit(360.0)), 2).alias("Azimuth"))
    step = p["sample_length"]
    cut = h.select("id", "HoleID", F.explode(F.sequence(F.lit(0), (F.floor(F.col("Length_m") / step) - 1).cast("int"))).alias("m"))
    cut = cut.select("id", "HoleID", "m", F.round(F.col("m") * step, 2).alias("From_m"), F.round((F.col("m") + 1) * step, 2).alias("To_m"))
    cut = cut.withColumn("mid_m", 0.5 * (F.col("From_m") + F.col("To_m"))).withColumn("interval_m", F.col("To_m") - F.col("From_m"))
    path = paths(collars, surveys, cut.select("HoleID", F.col("mid_m").alias("Depth_m")))
    cut = cut.join(path.select("HoleID", F.col("Depth_m").alias("mid_m"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z")), ["HoleID", "mid_m"])
    sx, sy = _slope(p)
    size = F.sqrt(1 + sx * sx + F.lit(sy * sy))
    away = (F.col("z") - surface(p)) / size
    shell = F.exp(-0.5 * (away / p["shell_thickness"]) ** 2)
    e = lambda what, sigma: F.exp(sigma * noise(seed, what, F.col("id"), F.col("m")))
    shared = e("shared", p["shared_noise"])
    cut = cut.withColumns({
        "Cu_pct": F.round(p["cu_background"] + p["cu_amplitude"] * shell * shared * e("cu", p["cu_noise"]), 4),
        "Au_gpt": F.round(p["au_background"] + p["au_amplitude"] * F.pow(shell, F.lit(1.4)) * shared * e("au", p["au_noise"]), 4),
        "true_pole_x": -sx / size, "true_pole_y": F.lit(-sy) / size, "true_pole_z": 1 / size,
    })
    pole: v.Vec = ("true_pole_x", "true_pole_y", "true_pole_z")
    cut = cut.withColumns({"true_strike_deg": v.col(v.strike(pole)), "true_dip_deg": v.col(v.dip(pole))})
    return Deposit(cut.drop("id", "m", "x", "y", "z"), collars, surveys, p)


def deposit_config(**given: Any) -> dict[str, Any]:
    return settings(**({"score_columns": ["Cu_pct", "Au_gpt"], "radius_m": 120.0, "min_neighbors": 60, "min_holes": 3, "distance_sigma_m": 80.0} | given))
