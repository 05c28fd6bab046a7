"""What plans have to look like, and estimators that a user adds."""

import re

import pytest
from pyspark.sql import functions as F

from planemark.functions.matrices import SIX
from planemark.operators import desurvey, export, neighbors, validation
from planemark.operators import estimators as es
from planemark.plans import fixtures as fx
from planemark.plans.prepare import prepare_points
from planemark.sources import tables


@pytest.fixture(scope="module")
def active(spark, sf):
    return prepare_points(tables.intervals(fx.points(spark, sf)), fx.config()).active


def joins(df):
    return re.findall(r"\w*Join\b", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])


def test_depths_are_sought_in_one_join(spark, sf):
    samples = tables.intervals(fx.points(spark, sf)).drop("Easting", "Northing", "Elevation")
    found, path = desurvey.desurveyed(samples, fx.collars(spark, sf), fx.surveys(spark, sf))
    # One with the collars and one with the paths.
    assert len(joins(found)) == 2 and len(joins(path)) == 0


def test_neighbours_are_sought_once_for_all_fields(active):
    f = es.orientations(active, fx.config())
    one, three = (validation.neighbor_agreements(dict.fromkeys(names, f), active, fx.config()) for names in ("a", "abc"))
    assert len(joins(one)) == len(joins(three)) == 1
    rows = three.collect()
    assert len(rows) == 495 and all(r.a == r.b == r.c for r in rows)
    median = validation.neighbor_agreements({"a": f.limit(0)}, active, fx.config())
    assert median.collect() == []


def test_no_product_and_no_single_task_between_samples(active):
    plan = neighbors.moments(neighbors.nodes(active), fx.config())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Cartesian|NestedLoop|SinglePartition", plan)


def test_an_estimator_of_ones_own(active):
    """The covariance in plan: without heights every pole lies flat or stands upright."""

    def in_plan(m, cfg):
        t = es.covariance(m, cfg)
        return t.withColumns({f"t{k}": F.lit(0.0) for k in SIX if "z" in k})

    es.register("in_plan", es.Estimator(in_plan, "major", graded=False, linearity_ceiling=0.5))
    try:
        rows = es.orientations(active, fx.config(estimator="in_plan")).collect()
        assert len(rows) == 495 and all(r.estimator == "in_plan" and abs(r.pole_vec_z) < 1e-9 and 0 <= r.linearity_norm <= 1 for r in rows)
    finally:
        del es.ESTIMATORS["in_plan"]
    with pytest.raises(KeyError):
        es.orientations(active, fx.config(estimator="in_plan"))
    with pytest.raises(ValueError):
        es.Estimator(in_plan, "middle")


def test_thinning_and_colours(spark):
    df = spark.createDataFrame([(k, float(k % 10)) for k in range(23)], "src_index long, v double")
    assert sorted(r.src_index for r in export.thinned(df, 5).collect()) == [0, 5, 10, 15, 20] and export.thinned(df, 0).count() == 23
    values = sorted(k % 10 for k in range(23))
    assert tuple(export.colour_range(df, "v", 0.1, 0.9).first()) == (values[2], values[20])
    assert tuple(export.colour_range(df.withColumn("v", F.lit(4.0)), "v").first()) == (4.0, 5.0)
    assert tuple(export.colour_range(df.limit(0), "v").first()) == (None, None)
