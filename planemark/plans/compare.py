"""Several estimators over the same samples, beside what the drill pattern alone would show."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import estimators, neighbors, validation
from ..sources.store import written

METHODS = ("shape_pca", "lsq_gradient")
REFERENCE = "drill_pattern"


@dataclass
class Comparison:
    """fields: by method, written; seconds: how long each took; summary: one row a method, or None with `skipped`, the reason."""

    fields: dict[str, DataFrame]
    seconds: dict[str, float]
    summary: DataFrame | None
    skipped: str | None = None


def compared(active: DataFrame, cfg: dict[str, Any], methods: tuple[str, ...] = METHODS, half: Column | None = None) -> Comparison:
    """Too few active samples for any neighbourhood, or no sample of any method past the gates, skip the comparison with a reason."""
    n_active = active.count()
    if n_active < cfg["min_neighbors"]:
        return Comparison({}, {}, None, f"only {n_active} active samples of {cfg['min_neighbors']} that a neighbourhood needs")
    fields, seconds, sums = {}, {}, {}
    # One search for neighbours gives an estimator's sums by half, and these the whole. What is in neither half counts for the whole alone.
    half = validation.random_half() if half is None else half
    for name in (*methods, REFERENCE):
        began = time.perf_counter()
        est = estimators.ESTIMATORS[name]
        sums[name] = written(neighbors.moments(neighbors.nodes(active), cfg, est.graded, est.lsq, split=F.coalesce(half.cast("int"), F.lit(-1))), "sums")
        fields[name] = written(estimators.orientations(active, cfg, name, sums=neighbors.over_halves(sums[name])), "field")
        seconds[name] = time.perf_counter() - began
    if all(f.isEmpty() for f in fields.values()):
        return Comparison(fields, seconds, None, f"no sample has {cfg['min_neighbors']} neighbours from {cfg['min_holes']} holes")
    more = validation.diagnostics(fields, active, cfg, half, sums=sums)
    return Comparison(fields, seconds, validation.summary(fields, REFERENCE, n_active, more, active, seconds))
