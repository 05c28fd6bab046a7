"""Orientation estimators. Each gives for a sample a symmetric matrix and says which of its axes is the pole:

shape_pca: covariance of the neighbours' places; the pole is its shortest axis, the line its longest.
lsq_gradient: outer product of a least-squares gradient; the pole is its longest axis, and there is no line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.matrices import SIX, add, eigen, eigen_lapack, eigenvalue_steps, solve_steps
from ..sources.store import written
from .neighbors import moments, nodes

CARRIED = ("src_index", "HoleID", "From_m", "To_m", "mid_m", "mid_x", "mid_y", "mid_z", "min_score", "interval_m")


@dataclass(frozen=True)
class Estimator:
    """make: (moments, cfg) -> rows with t.. of the matrix and perhaps `planarity`; gate: which of these rows count; more: further
    columns of the result."""

    make: Callable[[DataFrame, dict[str, Any]], DataFrame]
    pole: str
    lsq: bool = False
    graded: bool = True
    more: tuple[str, ...] = ()
    planarity_ceiling: float = 1.0
    linearity_ceiling: float = 1.0
    gate: Callable[[DataFrame, dict[str, Any]], DataFrame] | None = None

    def __post_init__(self) -> None:
        if self.pole not in ("major", "minor"):
            raise ValueError(f"pole must be 'major' or 'minor', not {self.pole!r}")

    def rows(self, m: DataFrame, cfg: dict[str, Any]) -> DataFrame:
        """What make gives, past the gate. With lsq both the moments and the result are written, one row a sample: the sums, the
        solution and the axes together would not fit into one compiled stage, nor a filter that Spark moves below the solution."""
        made = self.make(written(m, "moments") if self.lsq else m, cfg)
        if self.lsq:
            used = {"i", "half", "local_n", "local_holes", "planarity", *(f"t{k}" for k in SIX), *self.more}
            made = written(made.select(*(c for c in made.columns if c in used)), "gradients")
        return self.gate(made, cfg) if self.gate else made


def covariance(m: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    w = F.when(F.col("m0") > 0, F.col("m0")).otherwise(1.0)
    return m.withColumns({f"t{k}": F.col(f"m{k}") / w - F.col(f"m{k[0]}") / w * F.col(f"m{k[1]}") / w for k in SIX})


def gradient(m: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    w = F.when(F.col("m0") > 0, F.col("m0")).otherwise(1.0)
    m = m.withColumns({k: F.col(k) / w for k in (*(f"a{k}" for k in SIX), "bx", "by", "bz", "c")})
    m = add(m, eigenvalue_steps("a"))
    m = m.withColumn("sampling_conditioning", F.when(F.col("al1") > 0, F.col("al3") / F.when(F.col("al1") > 0, F.col("al1")).otherwise(1.0)).otherwise(0.0))
    m = add(m, solve_steps("a", "b", cfg["lsq_ridge"], "g"))
    gb = F.col("gx") * F.col("bx") + F.col("gy") * F.col("by") + F.col("gz") * F.col("bz")
    gag = sum((F.col(f"g{k[0]}") * F.col(f"g{k[1]}") * F.col(f"a{k}") * (1 if k[0] == k[1] else 2) for k in SIX), F.lit(0.0))
    # The closed form of 1 - residual / total sum of squares; without any contrast everything is explained.
    r2 = F.when(F.col("c") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 * gb - gag) / F.when(F.col("c") > 0, F.col("c")).otherwise(1.0)))).otherwise(1.0)
    m = m.withColumns({"gradient_r2": r2, "gradient_magnitude": F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2)})
    m = m.withColumns({f"t{k}": F.col(f"g{k[0]}") * F.col(f"g{k[1]}") for k in SIX})
    return m.withColumn("planarity", F.col("gradient_r2"))


def sloped(m: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    m = m.where("gradient_magnitude > 0")
    return m.where(F.col("sampling_conditioning") >= cfg["min_sampling_conditioning"]) if cfg["min_sampling_conditioning"] else m


ESTIMATORS = {
    "shape_pca": Estimator(covariance, "minor"),
    "lsq_gradient": Estimator(gradient, "major", lsq=True, more=("gradient_r2", "sampling_conditioning", "gradient_magnitude"), gate=sloped),
    # The same as shape_pca without grades: what the drill pattern alone would show.
    "drill_pattern": Estimator(covariance, "minor", graded=False),
}


def register(name: str, estimator: Estimator) -> None:
    ESTIMATORS[name] = estimator


def gated(m: DataFrame, min_neighbors: int, min_holes: int) -> DataFrame:
    m = m.where(F.col("local_n") >= min_neighbors)
    return m.where(F.col("local_holes") >= min_holes) if min_holes else m


def _ratio(a: Column, b: Column, ceiling: float = 1.0) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b).otherwise(1.0) / ceiling)


def field(t: DataFrame, estimator: Estimator, lapack: bool = False) -> DataFrame:
    """Eigenvalues, axes, angles and confidence of rows with a matrix; the one place where the pole's axis is chosen."""
    own = "planarity" in t.columns
    t = (eigen_lapack if lapack else eigen)(t)
    l1, l2, l3 = F.col("tl1"), F.col("tl2"), F.col("tl3")
    plane, line = (l1 - l2, l2 - l3) if estimator.pole == "major" else (l2 - l3, l1 - l2)
    pole, other = ("v1", "v3") if estimator.pole == "major" else ("v3", "v1")
    t = t.withColumns({"planarity": F.col("planarity") if own else _ratio(plane, l1), "linearity": _ratio(line, l1)})
    clip = lambda c, top: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / top)))
    t = t.withColumns({"planarity_norm": clip(F.col("planarity"), estimator.planarity_ceiling), "linearity_norm": clip(F.col("linearity"), estimator.linearity_ceiling)})
    t = t.withColumns({"eig1": l1, "eig2": l2, "eig3": l3} | {f"{n}_vec_{c}": F.col(f"{a}{c}") for n, a in (("line", other), ("pole", pole)) for c in "xyz"})
    p: v.Vec = ("pole_vec_x", "pole_vec_y", "pole_vec_z")
    q: v.Vec = ("line_vec_x", "line_vec_y", "line_vec_z")
    angles = {"line_trend_deg": v.trend(q), "line_plunge_deg": v.plunge(q), "pole_trend_deg": v.trend(p), "pole_plunge_deg": v.plunge(p), "plane_strike_deg": v.strike(p), "plane_dip_deg": v.dip(p)}
    return t.withColumns({k: v.col(e) for k, e in angles.items()})


FIELD = ("eig1", "eig2", "eig3", "planarity", "linearity", "planarity_norm", "linearity_norm", *(f"{n}_vec_{c}" for n in ("line", "pole") for c in "xyz"), "line_trend_deg", "line_plunge_deg", "pole_trend_deg", "pole_plunge_deg", "plane_strike_deg", "plane_dip_deg")


def orientations(active: DataFrame, cfg: dict[str, Any], name: str | None = None, lapack: bool = False, floor: float | None = None, sums: DataFrame | None = None) -> DataFrame:
    """The orientation field of the active samples that pass the gates. An unknown estimator is a KeyError. floor: the least score, if not
    that of `active`. sums: the estimator's moments, if they are there."""
    name = name or cfg["estimator"]
    est = ESTIMATORS[name]
    m = gated(moments(nodes(active), cfg, est.graded, est.lsq, floor=floor) if sums is None else sums, cfg["min_neighbors"], cfg["min_holes"])
    out = field(est.rows(m, cfg), est, lapack).select(F.col("i").alias("src_index"), F.lit(name).alias("estimator"), *FIELD, "local_n", "local_holes", *est.more)
    return active.select(*(c for c in CARRIED if c in active.columns)).join(out, "src_index")
