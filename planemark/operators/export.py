"""Fields in the form that modelling packages import, and plots' numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.matrices import add
from .ordering import numbered, running
from .score import hole_codes

# The columns of an export, in order.
EXPORT_COLUMNS = ["HoleID", "From_m", "To_m", "X", "Y", "Z", "Dip", "DipAzimuth", "Pitch", "Planarity", "Linearity", "LocalN", "LocalHoles", "VsReferenceDeg", "Estimator"]
#: Below it a line is noise and its pitch 0.
MIN_LINEARITY = 0.05


def export_table(field: DataFrame, vs_reference: DataFrame | None = None, decimals: int = 3) -> DataFrame:
    """field as EXPORT_COLUMNS, rounded half to even. vs_reference: (src_index, vs_reference_deg)."""
    if vs_reference is None:
        field = field.withColumn("vs_reference_deg", F.lit(None).cast("double"))
    else:
        field = field.join(vs_reference, "src_index", "left")
    field = add(field, v.pitch_steps("plane_strike_deg", "plane_dip_deg", ("line_vec_x", "line_vec_y", "line_vec_z"), "_pitch"))
    pitch = F.col("_pitch")
    linear = F.coalesce("linearity_norm", F.lit(0.0)) >= MIN_LINEARITY
    r = lambda c: F.bround(c, decimals)
    return field.select(
        F.col("HoleID").cast("string").alias("HoleID"), "From_m", "To_m", *(F.col(f"mid_{c.lower()}").alias(c) for c in "XYZ"),
        r(F.col("plane_dip_deg")).alias("Dip"), r(v.col(v.dip_azimuth("plane_strike_deg"))).alias("DipAzimuth"), r(F.when(linear, pitch).otherwise(0.0)).alias("Pitch"),
        F.bround("planarity_norm", 4).alias("Planarity"), F.bround("linearity_norm", 4).alias("Linearity"),
        F.col("local_n").alias("LocalN"), F.col("local_holes").alias("LocalHoles"), r(F.col("vs_reference_deg")).alias("VsReferenceDeg"), F.col("estimator").alias("Estimator"),
    )


def convention_check(planes: DataFrame) -> DataFrame:
    """planes (dip, dip_azimuth, rake): strike, normal and what dip, dip azimuth and pitch come back as."""
    out = planes.withColumn("strike", v.col(v.bearing("dip_azimuth - 90e0")))
    out = out.withColumns({f"n{c}": v.col(e) for c, e in zip("xyz", v.normal("strike", "dip"), strict=True)})
    # The line of a rake: along the strike by its cosine, down the dip by its sine.
    s, d, r = "radians(strike)", "radians(dip)", "radians(rake)"
    line = {"lx": f"cos({r}) * sin({s}) + sin({r}) * cos({d}) * cos({s})", "ly": f"cos({r}) * cos({s}) - sin({r}) * cos({d}) * sin({s})", "lz": f"-sin({r}) * sin({d})"}
    out = out.withColumns({k: v.col(e) for k, e in line.items()})
    n: v.Vec = ("nx", "ny", "nz")
    return out.withColumns({"dip_back": v.col(v.dip(n)), "dip_azimuth_back": v.col(v.dip_azimuth(v.strike(n))), "pitch_back": v.col(v.pitch("strike", "dip", ("lx", "ly", "lz")))})


def pole_density(field: DataFrame, size: int = 60, sigma: float = 0.09, bins: int = 200) -> DataFrame:
    """(gx, gy, density): a Gaussian mean over the poles on a grid over the equal-area disc.

    Poles are counted in `bins` x `bins` cells first, so the sums run over cells, however many poles there are.
    """
    x, y = v.equal_area("pole_trend_deg", "pole_plunge_deg")
    cells = field.select(v.col(x).alias("x"), v.col(y).alias("y")).groupBy(F.floor((F.col("x") + 1) * bins / 2).alias("cx"), F.floor((F.col("y") + 1) * bins / 2).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select(((F.col("cx") + 0.5) * 2 / bins - 1).alias("px"), ((F.col("cy") + 0.5) * 2 / bins - 1).alias("py"), "n")
    spark = field.sparkSession
    step = 2.0 / (size - 1)
    grid = spark.range(size * size).select((F.floor(F.col("id") / size) * step - 1).alias("gx"), (F.col("id") % size * step - 1).alias("gy")).where("gx * gx + gy * gy <= 1")
    # At most size * size grid places in each row's array: an explode of bounded length in place of a product.
    places = grid.agg(F.collect_list(F.struct("gx", "gy")).alias("g"))
    rows = cells.withColumn("_one", F.lit(1)).join(F.broadcast(places.withColumn("_one", F.lit(1))), "_one").select("px", "py", "n", F.inline("g"))
    d2 = (F.col("gx") - F.col("px")) ** 2 + (F.col("gy") - F.col("py")) ** 2
    return rows.groupBy("gx", "gy").agg((F.sum(F.col("n") * F.exp(-d2 / (2 * sigma * sigma))) / F.sum("n")).alias("density"))


# The arrays of a viewer's payload, each of how many numbers a sample, 32-bit floats but for the last.
ARRAYS = {"coords": 3, "poles": 3, "dip": 1, "dip_azimuth": 1, "trend": 1, "plunge": 1, "planarity": 1, "score": 1, "vs_reference": 1, "hole_index": 1}


def origin_of(active: DataFrame) -> tuple[float, float, float]:
    """The least coordinates of the active samples, from which 32-bit offsets are exact enough."""
    return tuple(active.agg(*(F.min(f"mid_{c}") for c in "xyz")).first())  # type: ignore[return-value]


def geometry_floats(field: DataFrame, origin: tuple[float, float, float], vs_reference: DataFrame | None = None) -> DataFrame:
    """(src_index and numbers of ARRAYS as 32-bit floats, hole_index as int), one row a sample with a pole: fx, fy, fz from the origin; px,
    py, pz; dip, dip_azimuth, trend, plunge, planarity, score; vs_reference, null where the reference has no pole; hole_index numbers
    the field's holes by their first sample."""
    field = field.withColumn("vs_reference_deg", F.lit(None).cast("double")) if vs_reference is None else field.join(vs_reference, "src_index", "left")
    field = field.join(hole_codes(field), "HoleID")
    made = {f"f{c}": F.col(f"mid_{c}") - o for c, o in zip("xyz", origin, strict=True)} | {f"p{c}": F.col(f"pole_vec_{c}") for c in "xyz"}
    made |= {"dip": F.col("plane_dip_deg"), "dip_azimuth": v.col(v.dip_azimuth("plane_strike_deg")), "trend": F.col("pole_trend_deg"), "plunge": F.col("pole_plunge_deg")}
    made |= {"planarity": F.col("planarity_norm"), "score": F.col("min_score"), "vs_reference": F.col("vs_reference_deg")}
    return field.select("src_index", *(e.cast("float").alias(k) for k, e in made.items()), F.col("hole_code").cast("int").alias("hole_index"))


def packed(rows: DataFrame, order: str, arrays: dict[str, list[str]], integers: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of rows in the order of a column: (first, n, and for each of `arrays` the columns' numbers row by row as little-endian bytes,
    32-bit integers for those of `integers` and else floats, null as NaN). Blocks in the order of `first` are the whole arrays. A block
    is a batch of a range of the order, so no task holds more."""
    columns = list(dict.fromkeys(c for cs in arrays.values() for c in cs))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out: list[pa.Array] = [pa.array([b.column(order)[0].as_py()], pa.int64()), pa.array([b.num_rows], pa.int64())]
            for name, cs in arrays.items():
                kind = "<i4" if name in integers else "<f4"
                out.append(pa.array([np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(kind) for c in cs], 1).tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["first", "n", *arrays])

    sorted_ = rows.select(order, *(c for c in columns if c != order)).repartitionByRange(order).sortWithinPartitions(order)
    return sorted_.mapInArrow(pack, "first long, n long, " + ", ".join(f"{k} binary" for k in arrays))


def geometry_blocks(floats: DataFrame) -> DataFrame:
    """ARRAYS of geometry_floats() as packed blocks in the order of src_index."""
    of = {"coords": ["fx", "fy", "fz"], "poles": ["px", "py", "pz"]}
    return packed(floats, "src_index", {k: of.get(k, [k]) for k in ARRAYS}, ("hole_index",))


def trace_points(traces: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """(HoleID, start, n, xyz): traces as from hole_traces() with their places as 32-bit offsets from the origin, one after the other; start:
    how many points the holes before have, by name, so that all traces are one array."""
    long = traces.select("HoleID", F.size("trace").cast("long").alias("n"), F.transform("trace", lambda p: F.array(*((p[c] - o).cast("float") for c, o in zip("xyz", origin, strict=True)))).alias("xyz"))
    ends = running(long, ["HoleID"], {"end": "n"})
    return ends.select("HoleID", (F.col("end") - F.col("n")).alias("start"), "n", F.flatten("xyz").alias("xyz"))


def thinned(field: DataFrame, every: int = 5, order: str = "src_index") -> DataFrame:
    """Each k-th row, from the first, in the order of a column, for a view of so many discs; below 1 is like 1."""
    return numbered(field, [order], "_nth").where(F.col("_nth") % max(1, every) == 0).drop("_nth")


def colour_range(field: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row (low, high): the values at these shares of the places, the nearest below, so that single values do not flatten a ramp of
    colours. If they are equal, high is one more; without values both are null."""
    counted = running(field.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), ["v"], {"upto": "n"})
    total = counted.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    at = {k: min(total - 1, math.floor(q * total)) for k, q in (("low", low), ("high", high))}
    ends = counted.agg(*(F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v"))).alias(name) for name, k in at.items()))
    return ends.select("low", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1).alias("high"))
