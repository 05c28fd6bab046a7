"""The radius join on plain, dense and odd cells."""

import random

import numpy as np
import pytest

from planemark.operators import neighbors


@pytest.fixture(scope="module")
def cloud():
    rng = random.Random(6)
    out = [(k, f"H{k % 9}", rng.uniform(-50, 50), rng.uniform(0, 60), rng.uniform(-5, 5)) for k in range(300)]
    out += [(300 + k, f"H{k % 4}", rng.uniform(10, 12), rng.uniform(10, 12), 0.5) for k in range(120)]  # one dense cell
    return out + [(500, "H0", 100.0, 0.0, 0.0), (501, "H1", 120.0, 0.0, 0.0), (502, "H2", 120.0, 0.0, 0.0), (503, "H3", -1e-17, 200.0, 0.0), (504, "H4", 20.0, 200.0, 0.0)]


def table(spark, cloud):
    return spark.createDataFrame([(i, h, x, y, z, float(i % 7), 1.5) for i, h, x, y, z in cloud], "i long, hole string, x double, y double, z double, s double, len double").repartition(3)


def wanted(cloud, radius, same_hole):
    d2 = lambda a, b: sum((b[k] - a[k]) ** 2 for k in (2, 3, 4))
    return {(a[0], b[0]) for a in cloud for b in cloud if a[0] != b[0] and 0 < d2(a, b) <= radius * radius and (same_hole or a[1] != b[1])}


@pytest.mark.parametrize(("dense", "around"), [(4096, 1 << 17), (20, 60), (1, 1 << 17), (4096, 10)])
@pytest.mark.parametrize("same_hole", [False, True])
def test_edges_against_a_loop(spark, cloud, monkeypatch, dense, around, same_hole):
    monkeypatch.setattr(neighbors, "DENSE", dense)
    monkeypatch.setattr(neighbors, "AROUND", around)
    rows = neighbors.edges(table(spark, cloud), 20.0, not same_hole).collect()
    assert len(rows) == len({(r.i, r.j) for r in rows}) and {(r.i, r.j) for r in rows} == wanted(cloud, 20.0, same_hole)
    at = {c[0]: c for c in cloud}
    assert all((r.hole, r.holej, r.s, r.sj, r.lenj) == (at[r.i][1], at[r.j][1], r.i % 7, r.j % 7, 1.5) and (r.dx, r.dy, r.dz) == tuple(at[r.j][k] - at[r.i][k] for k in (2, 3, 4)) for r in rows)


@pytest.mark.parametrize("dense", [4096, 5])
def test_two_tables(spark, cloud, dense):
    other = table(spark, cloud[::3]).selectExpr("i AS j", "x AS xj", "y AS yj", "z AS zj")
    got = {(r.i, r.j) for r in neighbors.near(table(spark, cloud), other, 15.0, dense=dense, around=7 * dense).collect()}
    assert got == {(a[0], b[0]) for a in cloud for b in cloud[::3] if sum((b[k] - a[k]) ** 2 for k in (2, 3, 4)) <= 225}


def test_no_task_has_more_of_a_cell_than_the_bound(spark, cloud):
    """How many rows a key of the join has, on either side."""
    n = table(spark, cloud)
    cells = neighbors._cells(n, ("x", "y", "z"), 20.0)
    steps = [s for s in neighbors._STEPS if s >= (0, 0, 0)]
    cut = neighbors._blocks(cells, cells, steps, 20, 60)
    here = neighbors._in_blocks(cells, cut, "_ka", "_kb", "_block_a", "_block_b")
    keys = [*neighbors.CELL, "_block_a", "_block_b"]
    # Blocks are dealt by hash: about even.
    assert max(r["count"] for r in here.groupBy(*keys).count().collect()) <= 40 < max(r["count"] for r in cells.groupBy(*neighbors.CELL).count().collect())


def test_no_points(spark, cloud):
    assert neighbors.edges(table(spark, cloud).limit(0), 20.0).collect() == []


@pytest.mark.parametrize("dense, around", [(None, None), (40, 30)])
def test_surfaces_near_samples(spark, dense, around):
    """Each sample once, with the numbers of the surfaces near it, whether or not cells are cut into blocks; some are near none."""
    rng = np.random.default_rng(11)
    samples, points = rng.uniform(0, 90, (300, 3)), rng.uniform(20, 140, (200, 3))
    surface = rng.integers(0, 5, 200)
    a = spark.createDataFrame([(i, *(float(x) for x in p)) for i, p in enumerate(samples)], "i long, x double, y double, z double").repartition(3)
    b = spark.createDataFrame([(int(k), *map(float, p)) for k, p in zip(surface, points, strict=True)], "surface int, x double, y double, z double")
    got = {r.i: sorted(r.surfaces) for r in neighbors.touched(b, a, 15.0, dense=dense, around=around).collect()}
    apart = ((samples[:, None] - points) ** 2).sum(axis=2) <= 15.0**2
    assert got == {i: sorted({int(k) for k in surface[row]}) for i, row in enumerate(apart)} and [] in got.values()
    assert all(r.surfaces == [] for r in neighbors.touched(b.where("false"), a, 15.0).collect())
