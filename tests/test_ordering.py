"""Places, running sums and quantiles over ranges, against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from planemark.operators import ordering


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(k, rng.choice(["a", "b", None]), rng.choice([rng.randrange(40), 7, rng.random() * 100])) for k in range(3000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(k, g, float(v)) for k, g, v in rows], "id long, g string, v double").repartition(5)


def test_places(table, rows):
    want = {k: i for i, (k, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r.id: r.at for r in ordering.numbered(table, ["v", "id"], "at").collect()} == want
    counts, by_group = {}, {}
    for k, g, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        by_group[k] = counts[g] = counts.get(g, -1) + 1
    assert {r.id: r.at for r in ordering.numbered(table, ["v", "id"], "at", ["g"]).collect()} == by_group


def test_running_sums(table, rows):
    total, want = {}, {}
    for k, g, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[k] = total[g] = total.get(g, 0) + k
    got = ordering.running(table, [F.col("v").desc(), F.col("id")], {"upto": "id"}, ["g"])
    assert {r.id: r.upto for r in got.collect()} == want


def test_quantiles_of_groups(spark, table, rows):
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p1": 1.0}
    for g, r in ((r.g, r) for r in ordering.quantiles(table, "v", shares, ["g"]).collect()):
        values = [v for _, h, v in rows if h == g]
        assert all(abs(r[k] - np.quantile(values, p)) < 1e-12 for k, p in shares.items())
    one = ordering.quantiles(table, "v", {"m": 0.5}).first()
    assert one.m == statistics.median(v for _, _, v in rows)


def test_quantiles_of_odd_tables(spark):
    df = spark.createDataFrame([("x", 3.0), ("x", None), ("x", float("nan")), ("y", None), ("z", 1.0), ("z", 1.0), ("z", 2.0)], "g string, v double")
    assert {r.g: r.m for r in ordering.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {"x": 3.0, "y": None, "z": 1.0}
    assert ordering.quantiles(df.limit(0), "v", {"m": 0.5}).collect()[0].m is None
    assert ordering.quantiles(df.limit(0), "v", {"m": 0.5}, ["g"]).collect() == []
    assert ordering.numbered(df.limit(0), ["v"], "at").collect() == []
    with pytest.raises(ValueError):
        ordering.quantiles(df, "v", {"m": 1.5})


def test_several_columns_at_once(spark):
    df = spark.createDataFrame([(float(k), float(k * k)) for k in range(11)], "a double, b double")
    assert ordering.quantiles_of(df, {"a50": ("a", 0.5), "b25": ("b", 0.25), "a90": ("a", 0.9)}).first().asDict() == {"a50": 5.0, "b25": 6.5, "a90": 9.0}


def test_no_task_orders_all_rows(spark, table):
    """Windows stand over ranges and groups; where one has no key, its rows are those of the ranges."""
    plan = ordering.numbered(table, ["v", "id"], "at")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 1 and "_range_of_order" in plan


def test_quantiles_of_many_values(spark):
    """Ties, infinities, groups of one value and values far apart, with the intervals of the places narrowed by counts; then only few rows are
    exchanged."""
    rng = random.Random(9)
    values = {"even": [rng.random() * 90 for _ in range(9000)], "ties": [float(rng.randrange(3)) for _ in range(4000)], "one": [5.0] * 700, "far": [10.0 ** rng.randrange(-300, 308) * rng.choice([-1, 1]) for _ in range(3000)]}
    values["ends"] = [float("-inf")] * 10 + values["even"][:500] + [float("inf")] * 10
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("none", None), (None, 3.0)], "g string, v double").repartition(6)
    shares = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in ordering.quantiles(df, "v", shares, ["g"], many=0).collect()}
    assert set(got) == {*values, "none", None} and got["none"].p50 is None and got[None].p50 == 3.0
    for g, vs in values.items():
        vs = sorted(vs)
        for k, p in shares.items():
            at = p * (len(vs) - 1)
            a, b = vs[int(at)], vs[-int(-at // 1)]
            assert got[g][k] == a if a == b else abs(got[g][k] - a - (at - int(at)) * (b - a)) <= 1e-12 * abs(a)
    one = ordering.quantiles(df.where("g = 'even'"), "v", {"m": 0.5}, many=0)
    assert one.first().m == statistics.median(values["even"])
    keys, rows = ["_key_0"], df.select(F.col("g").alias("_key_0"), F.col("v").alias("_v")).where("g = 'even'")
    places = rows.groupBy("_key_0").agg(F.count("_v").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select("*", F.lit("m").alias("_share"), (0.5 * (F.col("_all") - 1)).alias("_place"), F.lit(0).cast("long").alias("_below"))
    assert ordering._held(rows, ordering._narrowed(rows, places, keys), keys).count() < 30
