"""The sweep against single cases, its guards, and what a round of smoothing exchanges."""

import pytest
from pyspark.sql import functions as F

from planemark.operators import contacts as ct
from planemark.operators import estimators as es
from planemark.operators import neighbors as nb
from planemark.operators import smoothing
from planemark.operators import validation as va
from planemark.plans import fixtures as fx
from planemark.plans import sweep
from planemark.plans.prepare import prepare_points
from planemark.sources import tables
from planemark.sources.store import bucketed, written


@pytest.fixture(scope="module")
def parts(spark, sf):
    cfg = fx.config(min_holes=6)
    active = prepare_points(tables.intervals(fx.points(spark, sf)), cfg).active
    contacts = written(ct.extract_contacts(fx.logged(spark, sf), fx.collars(spark, sf), fx.surveys(spark, sf)), "contacts")
    return cfg, active, contacts, written(ct.fit_contact_planes(contacts), "planes")


def test_sweep_against_one_case_at_a_time(spark, parts):
    cfg, active, contacts, planes = parts
    rows = sweep.sweep(active, cfg, planes, contacts, radii=(90.0, 120.0), smoothings=((0, 0.0), (2, 0.5)), least_shared=300).collect()
    assert len(rows) == 2 and [r.contact_err for r in rows] == sorted(r.contact_err for r in rows)
    for r in rows:
        one = cfg | {"radius_m": r.radius, "distance_sigma_m": 0.67 * r.radius, "min_neighbors": sweep.needed(r.radius)}
        n = nb.nodes(active)
        rounds = int(r.smooth[0])
        s = smoothing.smooth_scores(n, nb.edge_weights(n, one).select("i", "j", "w"), rounds, 0.5) if rounds else n.select("i", "s")
        # The smallest score for weights is that of the scores as given, so only the gradient sees the smoothed ones.
        e = nb.edge_weights(n, one).join(s.selectExpr("i", "s AS si"), "i").join(s.selectExpr("i AS j", "s AS sk"), "j")
        delta = (F.col("sk") - F.col("si")) / F.sqrt("d2")
        m = e.withColumn("delta", delta).groupBy("i").agg(
            F.sum("w").alias("m0"), *(F.sum(F.col("w") * F.col(f"d{k[0]}") * F.col(f"d{k[1]}") / F.col("d2")).alias(f"a{k}") for k in sweep.SIX), *(F.sum(F.col("w") * F.col("delta") * F.col(f"d{c}") / F.sqrt("d2")).alias(f"b{c}") for c in "xyz"),
            F.sum(F.col("w") * F.col("delta") * F.col("delta")).alias("c"), F.count(F.lit(1)).alias("local_n"), F.countDistinct("holej").alias("local_holes"),
        ).where((F.col("local_n") >= one["min_neighbors"]) & (F.col("local_holes") >= 6))
        est = es.ESTIMATORS["lsq_gradient"]
        f = written(es.field(est.rows(m, one), est).withColumnRenamed("i", "src_index"), "field")
        versus = va.versus(f, es.orientations(active, one, "drill_pattern")).agg(F.median("vs_reference_deg")).first()[0]
        where = active.select("src_index", "mid_x", "mid_y", "mid_z")
        error = ct.weighted_error(ct.compare_to_planes(f.join(where, "src_index"), planes, contacts).withColumn("m", F.lit(1)), ["m"]).first().weighted_err_deg
        assert r.n_valid == f.count() and r.min_n == one["min_neighbors"]
        assert abs(r.vs_reference - versus) < 1e-6 and abs(r.contact_err - error) < 1e-6 and abs(r.r2_med - f.agg(F.median("gradient_r2")).first()[0]) < 1e-9
        if not rounds:
            apart = va.split_half(active, one, va.random_half(), "lsq_gradient").agg(F.median("angle_deg")).first()[0]
            assert abs(r.stability - apart) < 1e-6


def test_guards_of_the_sweep(spark, parts):
    cfg, active, contacts, planes = parts
    assert sweep.sweep(active, cfg, planes, contacts, radii=(120.0,), smoothings=((0, 0.0),), least_shared=10**6).collect() == []
    assert sweep.sweep(active, cfg, planes.where("false"), contacts, radii=(120.0,), smoothings=((0, 0.0),)).collect() == []


def test_a_round_exchanges_values_and_sums_alone(spark):
    """Neither side of the join with the pairs is broadcast here, as at scale; the pairs come from their buckets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = bucketed(spark.range(2000).selectExpr("id % 97 AS i", "id % 89 AS j", "1.0D AS w"), "j", "pairs")
        values = written(spark.range(97).selectExpr("id AS i", "id * 1.0D AS s"), "values")
        plan = smoothing.neighbour_means(values, pairs, ["s"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2


def test_sweep_keeps_no_pairs(spark, parts, tmp_path):
    """What the sweep writes goes with the samples and cases, not with the pairs: here over 100 a sample within 120 m."""
    cfg, active, contacts, planes = parts
    kept = []
    was = sweep.written
    sweep.written = lambda df, name: kept.append((name, was(df, name))) or kept[-1][1]
    sums = sweep.discard
    sweep.discard = lambda *tables: None
    try:
        sweep.sweep(active, cfg, planes, contacts, radii=(120.0,), smoothings=((0, 0.0), (1, 0.5)))
    finally:
        sweep.written, sweep.discard = was, sums
    assert {name.split("-")[0] for name, _ in kept} == {"nodes", "cases", "sweep"}
    assert max(df.count() for _, df in kept) <= 2 * active.count()


def test_sweep_of_crowded_cells(spark, parts):
    """Samples near which too many lie go by joined pairs, and come to the same."""
    cfg, active, contacts, planes = parts
    given = dict(radii=(90.0, 120.0), smoothings=((0, 0.0), (1, 0.5)), least_shared=100)
    a = {(r.radius, r.smooth): r for r in sweep.sweep(active, cfg, planes, contacts, **given).collect()}
    b = {(r.radius, r.smooth): r for r in sweep.sweep(active, cfg, planes, contacts, **given, around=1).collect()}
    assert a and a.keys() == b.keys()
    for k, r in a.items():
        assert r.n_valid == b[k].n_valid and all(abs(r[c] - b[k][c]) < 1e-6 for c in ("contact_err", "stability", "vs_reference", "r2_med", "cond_med"))
