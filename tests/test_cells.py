"""Sums over neighbours made within cells, against those over pairs; no pairs are kept."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planemark.operators import neighbors, smoothing, validation
from planemark.plans import fixtures as fx
from planemark.plans.queries import REGISTRY
from planemark.sources.store import Scratch


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = [(k, f"H{k % 9}", rng.uniform(-300, 300), rng.uniform(0, 200), rng.uniform(-50, 50), rng.uniform(-1, 1), 1.5) for k in range(300)]
    rows += [(300 + k, f"H{k % 4}", rng.uniform(10, 20), rng.uniform(10, 20), 0.5, 0.1 * k, None) for k in range(60)]
    rows += [(500, "H0", 700.0, 0.0, 0.0, 1.0, 1.5), (501, "H1", 820.0, 0.0, 0.0, 1.0, 1.5), (502, "H2", 820.0, 0.0, 0.0, 1.0, 1.5), (503, "H3", 9000.0, 0.0, 0.0, 1.0, 1.5)]
    return spark.createDataFrame(rows, "i long, hole string, x double, y double, z double, s double, len double").repartition(3)


def same(a, b, keys):
    key = lambda r: tuple(r[k] for k in keys)
    a, b = ({key(r): r.asDict() for r in df.collect()} for df in (a, b))
    assert set(a) == set(b) and a
    for k, r in a.items():
        assert all(r[c] == v if not isinstance(v, float) else math.isclose(r[c], v, rel_tol=1e-9, abs_tol=1e-7) for c, v in b[k].items()), (k, r, b[k])


@pytest.mark.parametrize("around", [None, 100])
@pytest.mark.parametrize("changed", [{}, {"decluster_by_hole": False}, {"exclude_same_hole_neighbors": False}])
def test_sums_in_cells_are_those_over_pairs(spark, table, around, changed):
    cfg = fx.config(**changed)
    pairs = neighbors.edge_weights(table, cfg).localCheckpoint()
    assert pairs.where("i = 501 AND j = 500").count() == 1  # at the radius itself
    weights = pairs.groupBy("i", "holej").agg(F.count("*").alias("n"), F.sum("w").alias("sum_w"), F.max("w").alias("max_w"))
    same(neighbors.hole_weights(table, cfg, around=around), weights, ["i", "holej"])
    same(neighbors.moments(table, cfg, around=around), neighbors._joined_moments(table, table, cfg, True, False, None, neighbors.least_score(table)), ["i"])
    half = F.substring("holej", 2, 1).cast("int") % 2
    same(neighbors.moments(table, cfg, False, True, half, around=around), neighbors._joined_moments(table, table, cfg, False, True, half, 0.0), ["i", "half"])
    values = table.where("i % 5 <> 0").select("i", "s")
    same(neighbors.means_over(table, cfg, around=around)(values, ["s"]), smoothing.neighbour_means(values, pairs.select("i", "j", "w"), ["s"]), ["i"])


@pytest.mark.parametrize("around", [None, 100])
def test_agreement_in_cells(spark, table, around):
    """Findings F3, F13, F14: medians of angles made in cells, against those over pairs."""
    active = table.selectExpr("i AS src_index", "hole AS HoleID", "x AS mid_x", "y AS mid_y", "z AS mid_z", "s AS min_score", "len AS interval_m")
    angle = F.radians(F.col("src_index") * 7.0)
    f = active.where("src_index % 3 > 0").select("src_index", F.cos(angle).alias("pole_vec_x"), F.sin(angle).alias("pole_vec_y"), F.lit(0.0).alias("pole_vec_z"))
    cfg = fx.config()
    wide = neighbors.nodes(active).join(f.select(F.col("src_index").alias("i"), *(F.col(f"pole_vec_{c}").alias(f"p0{c}") for c in "xyz")), "i", "left")
    got = validation.neighbor_agreements({"a": f, "b": f.limit(0)}, active, cfg, around)
    assert got.where("b IS NOT NULL").count() == 0
    same(got.drop("b"), validation._joined_agreements(["a"], wide, wide, cfg), ["src_index"])


def test_no_points(spark, table):
    assert neighbors.moments(table.limit(0), fx.config()).collect() == []


@pytest.mark.parametrize("name", ["smooth_scores_3", "smooth_tensor_2", "edge_weights_declustered", "edge_weights_ungraded"])
def test_no_pairs_are_kept(spark, sf, name):
    """Findings F1, F2, F5 to F7: tables between the steps have a row a sample at most."""
    with Scratch() as scratch:
        assert REGISTRY[name](spark, sf).count() > 0
        assert max(t.count() for t in scratch.tables) <= 1000
