"""Finding F4 of round 4 (table_route): hole paths in one order of depths, and places for active samples alone."""

import re

from pyspark.sql import functions as F

from planemark.operators import desurvey
from planemark.plans import fixtures as fx
from planemark.plans.prepare import prepare_tables
from planemark.sources import tables
from planemark.sources.store import Scratch


def test_windows_over_a_hole_share_one_order(spark, sf):
    samples = tables.intervals(fx.points(spark, sf))
    path = desurvey.paths(fx.collars(spark, sf), fx.surveys(spark, sf), desurvey.all_depths(samples))
    plan = path._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # Down the hole alone; before, the depths were ordered down, up and down again.
    assert "Window" in plan and not re.search(r"Sort \[[^\]]*DESC", plan)


def test_depths_before_between_and_beyond_stations(spark):
    collars = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 90.0, -90.0, 0.0), ("B", 5.0, 0.0, 0.0, 90.0, -90.0, 0.0)], "HoleID string, Easting double, Northing double, Elevation double, Length_m double, Dip double, Azimuth double")
    surveys = spark.createDataFrame([("A", 0.0, -90.0, 0.0), ("A", 20.0, -90.0, 0.0), ("A", 40.0, -45.0, 90.0), ("B", 0.0, -60.0, 0.0)], "HoleID string, Depth_m double, Dip double, Azimuth double")
    depths = spark.createDataFrame([("A", -5.0), ("A", 10.0), ("A", 10.0), ("A", 30.0), ("A", 60.0), ("B", 7.0), ("C", 1.0), ("A", None)], "HoleID string, Depth_m double")
    rows = {(r.HoleID, r.Depth_m): r for r in desurvey.paths(collars, surveys, depths).collect()}
    assert set(rows) == {("A", d) for d in (-5.0, 0.0, 10.0, 20.0, 30.0, 40.0, 60.0)} | {("B", 0.0), ("B", 7.0)}
    assert abs(rows["A", -5.0].uz + 1) < 1e-12 and abs(rows["A", 10.0].uz + 1) < 1e-12 and abs(rows["A", 10.0].Z + 15) < 1e-9
    assert 0 < rows["A", 30.0].ux < rows["A", 40.0].ux and rows["A", 60.0].ux == rows["A", 40.0].ux
    assert rows["B", 7.0].uz == rows["B", 0.0].uz


def test_only_active_samples_are_placed(spark, sf):
    cfg = fx.config()
    given = tables.load_tables(spark, fx.points(spark, sf).drop("Easting", "Northing", "Elevation"), fx.collars(spark, sf), fx.surveys(spark, sf), cfg)
    with Scratch() as scratch:
        p = prepare_tables(*given, cfg)
        names = [t._written_at.rsplit("/", 1)[-1].split("-")[0] for t in scratch.tables]
        # Each given table is made once.
        assert all(names.count(x) == 1 for x in ("samples", "collars", "surveys", "paths", "active"))
        whole = p.scored
        assert whole.columns == p.active.columns and whole.count() == given[0].count()
        rest = whole.where("is_active").select("src_index", "mid_x", "mid_y", "mid_z", F.round("min_score", 9)).exceptAll(p.active.select("src_index", "mid_x", "mid_y", "mid_z", F.round("min_score", 9)))
        assert p.active.where("NOT is_active").count() == 0 and rest.count() == 0
        # A score of what comes with the places.
        assert prepare_tables(*given, cfg | {"score_columns": ["hole_length_m"]}).active.count() > 0
