"""Application actions and the stream of new files."""

import base64
import json
import statistics

import numpy as np
import pandas as pd

from planemark.plans import compare, fixtures
from planemark.plans.prepare import prepare_points
from planemark.plans.session import Session
from planemark.sources import tables
from planemark.streaming.ingest import append_points, point_stream


def test_actions(spark, sf):
    csv = fixtures.raw_points(spark, sf).drop("src_index", "LowRecovery").where("BHID IN ('H0', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6')").toPandas().to_csv(index=False)
    s = Session(spark)
    do = lambda a, **p: json.loads(s.handle(a, json.dumps(p)))
    assert not do("dance")["ok"] and not do("run")["ok"]
    known = do("versions")["result"]
    assert known["defaults"]["radius_m"] == 120.0 and "shape_pca" in known["estimators"]
    seen = do("preview", csv=csv)["result"]
    assert [a["name"] for a in seen["numeric_columns"]] == ["assay"] and {m["internal"]: m["status"] for m in seen["mapping"]}["Northing"] == "ok"
    values = [float(r.split(",")[3]) for r in csv.splitlines()[1:] if r.split(",")[3] not in ("-", "<0.01")][: seen["n_preview_rows"]]
    assert abs(seen["numeric_columns"][0]["median"] - statistics.median(values)) < 1e-9 and seen["numeric_columns"][0]["max"] == max(values)
    assert seen["resolved"] and seen["missing"] == [] and do("preview", csv="a,b\n1,2\n", columns={})["result"]["missing"][0] == "HoleID"
    do("preview", csv=csv)
    given = {"score_column": "assay", "active_score_quantile": 0.5, "min_neighbors": 5, "min_holes": 2}
    loaded = do("load", csv=csv, **given)["result"]
    assert loaded["n_holes"] == 7 and loaded["active_curve"]["counts"][0] == loaded["n_rows"] and loaded["assay"]["column"] == "assay"
    assert set(loaded) == {"n_rows", "n_holes", "extent", "interval_m", "assay", "search_radius_m", "rim", "support", "active_curve"} and loaded["rim"]["n_exposed"] <= loaded["n_rows"]
    out = do("run", **given)["result"]
    assert set(out) == {"ok", "estimator", "n_active", "neighbors", "n_valid", "pct_active", "timing_s", "diagnostics", "true_error_deg", "geometry"}
    assert set(out["neighbors"]) == {"median", "p10", "max", "holes_median", "failed_on_neighbors", "failed_on_holes"} and set(out["timing_s"]) == {"prepare", "method", "reference"}
    assert set(out["diagnostics"]) == {"vs_reference_deg", "coherence_deg", "coherence_null_deg", "stability_deg", "n_stability"} and out["true_error_deg"] is None
    assert out["n_valid"] > 50 and 0 <= out["diagnostics"]["vs_reference_deg"] <= 90 and out["pct_active"] == 100.0 * out["n_valid"] / out["n_active"]
    # The arrays against the tables they come from.
    g, field = out["geometry"], s.field.orderBy("src_index").toPandas()
    floats = lambda k, of=g: np.frombuffer(base64.b64decode(of[k]), "<f4")
    assert g["n"] == len(field) and np.allclose(floats("coords").reshape(-1, 3), field[["mid_x", "mid_y", "mid_z"]] - g["origin"], atol=1e-3)
    assert np.allclose(floats("poles").reshape(-1, 3), field[["pole_vec_x", "pole_vec_y", "pole_vec_z"]], atol=1e-6) and np.allclose(floats("dip_azimuth"), (field["plane_strike_deg"] + 90) % 360, atol=1e-3)
    codes = np.frombuffer(base64.b64decode(g["hole_index"]), "<i4")
    assert (codes == pd.factorize(field["HoleID"])[0]).all()
    ends, traces = np.frombuffer(base64.b64decode(g["trace_offsets"]), "<i4"), floats("trace_xyz").reshape(-1, 3)
    assert g["trace_names"] == sorted(f"H{k}" for k in range(7)) and ends[0] == 0 and ends[-1] == len(traces) == loaded["n_rows"]
    h3 = s.points.where("HoleID = 'H3'").orderBy("mid_m").select("Easting", "Northing", "Elevation").toPandas().to_numpy()
    assert np.allclose(traces[ends[3] : ends[4]], h3 - g["origin"], atol=1e-3) and g["reference"]["n"] == len(floats("trend", g["reference"]))
    short = do("run", **given, with_stability=False, with_geometry=False)["result"]
    assert "geometry" not in short and "stability_deg" not in short["diagnostics"] and short["diagnostics"]["coherence_deg"] == out["diagnostics"]["coherence_deg"]
    table = do("export")["result"]
    assert table["n_rows"] == out["n_valid"] and table["columns"][6] == "Dip"
    none = do("run", score_column="assay", cfg={"min_neighbors": 10**6})["result"]
    assert not none["ok"] and none["empty"] and none["diagnosis"]["failed_on_neighbors"] == none["diagnosis"]["n_active"]
    assert not do("run", score_column="assay", cfg={"active_score_quantile": 2.0})["ok"] and not do("run", cfg={"no_such": 1})["ok"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("BHID,From,To,X,Y,Z,Cu\na,0,1.5,1,2,3,0.5\na,1.5,1.5,1,2,3,0.5\nb,0,2,,2,3,-\n")
    cfg = fixtures.config(score_columns=["Cu"])
    append_points(point_stream(spark, str(tmp_path / "in"), ["BHID", "From", "To", "X", "Y", "Z", "Cu"], cfg), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.HoleID, r.mid_m, r.Cu) for r in rows] == [("a", 0.75, 0.5)]


def test_comparison_guards(spark, sf):
    """Too few samples, and no sample past the gates, are reasons and not empty tables."""
    cfg = fixtures.config()
    active = prepare_points(tables.intervals(fixtures.points(spark, sf)), cfg).active
    assert "active samples" in compare.compared(active.limit(3), cfg).skipped
    out = compare.compared(active, fixtures.config(min_holes=10**6))
    assert out.summary is None and "neighbours" in out.skipped and set(out.fields) == {"shape_pca", "lsq_gradient", "drill_pattern"}
