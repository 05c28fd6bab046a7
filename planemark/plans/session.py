"""An application's actions: versions, preview, load, run, export. `handle` takes and gives JSON and never raises."""

from __future__ import annotations

import base64
import json
import math
import sys
import time
import traceback
from typing import Any

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, settings_from_payload
from ..operators import estimators, export, neighbors, score, validation
from ..operators.ordering import quantiles
from ..sources import tables
from ..sources.store import Scratch, discard, written
from .compare import REFERENCE
from .prepare import Prepared, prepare_points

#: The settings that an application offers.
EXPOSED = ("estimator", "radius_m", "min_neighbors", "min_holes", "distance_sigma_m", "active_score_quantile", "log_transform_score")


def plain(x: Any) -> Any:
    """x for JSON: numbers that are not finite are null."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


class Session:
    """Holds the loaded points and the last field, as tables, between actions."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.source: str | DataFrame | None = None
        self.points: DataFrame | None = None
        self.prepared: Prepared | None = None
        self.field: DataFrame | None = None
        self.versus: DataFrame | None = None

    def _source(self, payload: dict[str, Any]) -> str | DataFrame:
        if payload.get("csv"):
            self.source = tables.csv_text(self.spark, payload["csv"])
        elif payload.get("path"):
            self.source = payload["path"]
        if self.source is None:
            raise ValueError("no table was given")
        return self.source

    def versions(self, payload: dict[str, Any]) -> dict[str, Any]:
        return {"spark": pyspark.__version__, "python": sys.version.split()[0], "defaults": {k: DEFAULTS[k] for k in EXPOSED}, "estimators": sorted(estimators.ESTIMATORS)}

    def preview(self, payload: dict[str, Any]) -> dict[str, Any]:
        return tables.preview(self.spark, self._source(payload), "points", settings_from_payload(payload))

    def load(self, payload: dict[str, Any]) -> dict[str, Any]:
        cfg = settings_from_payload(payload)
        points = tables.load_points(self.spark, self._source(payload), cfg)
        if points.isEmpty():
            raise ValueError("no row has a positive interval and coordinates")
        self.points, self.field = points, None
        assay = cfg["score_columns"][0]
        stats = {r["column"]: r.asDict() for r in tables.column_stats(points, ["interval_m", assay]).collect()}
        ranked = score.scored(points, cfg["score_columns"], cfg["log_transform_score"], cfg["active_score_quantile"])
        curve = score.active_curve(ranked).orderBy("quantile").collect()
        typical, box, rim = stats["interval_m"]["median"], one(tables.extent(points)), one(tables.rim_exposure(points, cfg["radius_m"]))
        return {
            "n_rows": box["n"], "n_holes": box["n_holes"], "extent": {k: [box[f"min_{c}"], box[f"max_{c}"]] for k, c in (("x", "Easting"), ("y", "Northing"), ("z", "Elevation"))},
            "interval_m": stats["interval_m"], "assay": stats[assay] | {"column": assay}, "search_radius_m": cfg["radius_m"],
            "rim": {"radius_m": cfg["radius_m"], "n_exposed": rim["n_rim"], "pct_exposed": 100.0 * rim["share"], "span_x_m": box["max_Easting"] - box["min_Easting"], "span_y_m": box["max_Northing"] - box["min_Northing"]},
            "support": {"min_neighbors": cfg["min_neighbors"], "median_interval_m": typical, "effective_core_m": cfg["min_neighbors"] * typical},
            "active_curve": {"quantiles": [r["quantile"] for r in curve], "counts": [r["count"] for r in curve]},
        }

    def run(self, payload: dict[str, Any]) -> dict[str, Any]:
        """As in estimate(); of the tables made on the way those stay that an export needs."""
        old = (self.field, self.versus, self.prepared and self.prepared.active)
        with Scratch() as scratch:
            out = self.estimate(payload)
            for t in (self.field, self.versus, self.prepared and self.prepared.active):
                if t is not None:
                    scratch.keep(t)
        discard(*old)
        return out

    def estimate(self, payload: dict[str, Any]) -> dict[str, Any]:
        """The field and what it takes to judge it. Without any sample past the gates: ok false and why. with_stability false leaves out the
        halves of the holes, with_geometry false the arrays of a view."""
        if self.points is None:
            raise ValueError("load a table first")
        cfg = settings_from_payload(payload)
        name, seconds = cfg["estimator"], {}

        def timed(what: str, made: DataFrame) -> DataFrame:
            began = time.perf_counter()
            out = written(made, what)
            seconds[what] = time.perf_counter() - began
            return out

        began = time.perf_counter()
        self.prepared = prepare_points(self.points, cfg)
        active = self.prepared.active
        n_active = active.count()
        seconds["prepare"] = time.perf_counter() - began
        if not n_active:
            raise ValueError(f"no sample is active: active_score_quantile {cfg['active_score_quantile']} chose none")
        self.field = timed("method", estimators.orientations(active, cfg, name))
        seen = one(neighbors.gate_diagnosis(neighbors.nodes(active), cfg))
        numbers = {"median": seen["median_local_n"], "p10": seen["p10_local_n"], "max": seen["max_local_n"], "holes_median": seen["median_local_holes"], "failed_on_neighbors": seen["failed_local_n"], "failed_on_holes": seen["failed_local_holes"]}
        n_valid = self.field.count()
        if not n_valid:
            self.field = self.versus = None
            return {"ok": False, "empty": True, "diagnosis": {"n_active": n_active, "min_neighbors": cfg["min_neighbors"], "min_holes": cfg["min_holes"]} | numbers}
        reference = timed("reference", estimators.orientations(active, cfg, REFERENCE))
        self.versus = written(validation.versus(self.field, reference), "versus")
        half = validation.random_half() if payload.get("with_stability", True) else None
        judged = one(validation.diagnostics({name: self.field}, active, cfg, half).drop("method"))
        truth = None
        if "true_pole_x" in active.columns:
            truth = quantiles(validation.true_error(self.field, active), "error_deg", {"m": 0.5}).first()["m"]
        out = {
            "ok": True, "estimator": name, "n_active": n_active, "neighbors": numbers, "n_valid": n_valid, "pct_active": 100.0 * n_valid / n_active, "timing_s": seconds,
            "diagnostics": {"vs_reference_deg": quantiles(self.versus, "vs_reference_deg", {"m": 0.5}).first()["m"]} | judged, "true_error_deg": truth,
        }
        return out | ({"geometry": self.geometry(active, reference)} if payload.get("with_geometry", True) else {})

    def geometry(self, active: DataFrame, reference: DataFrame) -> dict[str, Any]:
        """The arrays of a view, each as base64 of its bytes: what one screen shows, fetched in packed blocks. Tables of any size stay in
        geometry_blocks and trace_points."""
        origin = export.origin_of(active)
        blocks = export.geometry_blocks(export.geometry_floats(self.field, origin, self.versus)).orderBy("first").collect()
        there = reference.select("src_index", F.col("pole_trend_deg").cast("float").alias("trend"), F.col("pole_plunge_deg").cast("float").alias("plunge"))
        others = export.packed(there, "src_index", {"trend": ["trend"], "plunge": ["plunge"]}).orderBy("first").collect()
        traces = export.trace_points(self.prepared.paths, origin).orderBy("HoleID").collect()
        text = lambda parts: base64.b64encode(b"".join(parts)).decode()
        offsets = [*(t["start"] for t in traces), sum(t["n"] for t in traces)]
        return {
            "n": sum(b["n"] for b in blocks), "origin": list(origin), **{k: text(b[k] for b in blocks) for k in export.ARRAYS},
            "reference": {"n": sum(b["n"] for b in others)} | {k: text(b[k] for b in others) for k in ("trend", "plunge")},
            "trace_xyz": text(np.array(t["xyz"], "<f4").tobytes() for t in traces), "trace_offsets": text([np.array(offsets, "<i4").tobytes()]), "trace_names": [t["HoleID"] for t in traces],
        }

    def export(self, payload: dict[str, Any]) -> dict[str, Any]:
        """CSV text of the last field: an application's file, not a cluster's; write_csv is for those."""
        if self.field is None:
            raise ValueError("run an estimate first")
        df = export.export_table(self.field, self.versus)
        return {"csv": tables.as_csv_text(df), "n_rows": df.count(), "columns": df.columns}

    def handle(self, action: str, payload: str = "{}") -> str:
        try:
            if action not in ("versions", "preview", "load", "run", "export"):
                raise KeyError(f"no such action: {action}")
            return json.dumps(plain({"ok": True, "result": getattr(self, action)(json.loads(payload))}), default=str)
        except Exception as e:  # the caller shows whatever went wrong
            return json.dumps({"ok": False, "error": str(e), "error_type": type(e).__name__, "traceback": traceback.format_exc()})
