"""Findings F2 and F3 of round 4 (method_summary, parameter_sweep): pairs are sought in cubes, and a round of the sweep keeps its weights."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from planemark.operators import neighbors as nb
from planemark.operators import validation
from planemark.plans import compare, sweep
from planemark.plans import fixtures as fx
from planemark.plans.prepare import prepare_points
from planemark.sources import tables


def _places(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(-300, 300, n), rng.uniform(0, 2000, n), rng.uniform(-40, 40, n)])


def test_cubes_find_all_pairs_among_few():
    place = _places(3000)
    place[7] = np.nan
    rows = np.flatnonzero(place[:, 1] < 1500)
    rows = np.union1d(rows, [7])
    found, tried = set(), 0
    for mine, others in nb.in_cubes(place, rows, 100.0, 1 << 12):
        assert (np.diff(mine) > 0).all() and (np.diff(others) > 0).all()
        tried += len(mine) * len(others)
        assert len(mine) == 1 or len(mine) * len(others) <= 1 << 12
        line, column = np.nonzero(nb.distances(place, mine, others) <= 100.0**2)
        found |= set(zip(mine[line].tolist(), others[column].tolist(), strict=True))
    d = place[rows][:, None] - place
    line, column = np.nonzero((d * d).sum(axis=2) <= 100.0**2)
    assert found == set(zip(rows[line].tolist(), column.tolist(), strict=True))
    # Of all pairs but a few are tried.
    assert tried < len(rows) * len(place) / 4


def _task(n=900, radii=(60.0, 120.0)):
    place, rng = _places(n, 3), np.random.default_rng(4)
    hole = rng.integers(0, 40, n)
    group = pa.table({
        "i": np.arange(n), "hole": pa.array([f"H{h}" for h in hole]), **{c: place[:, k] for k, c in enumerate("xyz")}, "s": rng.normal(size=n), "len": np.full(n, 1.5),
        "half": hole % 2, "_own": (place[:, 1] > 700) & (place[:, 1] < 1300), "_hx": np.zeros(n, int), "_hy": np.zeros(n, int), "_hz": np.zeros(n, int),
    })
    task = sweep._Task(group, 1000.0, radii, fx.config(min_holes=4), -3.0)
    y = task.place[:, 1]
    task.apart = np.maximum(np.maximum(700 - y, y - 1300), 0.0)
    return task


def test_rounds_find_pairs_once(monkeypatch):
    """Kept weights give what weights made anew do; only the first round looks for the pairs of what later rounds need."""
    smoothings = ((0, 0.0), (2, 0.5), (4, 0.7))
    sought = []
    whole = nb.in_cubes
    monkeypatch.setattr(nb, "in_cubes", lambda place, rows, radius, at_once: sought.append(len(rows)) or whole(place, rows, radius, at_once))
    task = _task()
    kept = task.smoothed(smoothings)
    assert len(sought) == 4 and sought[0] > 0 and sought[1:] == [0, 0, 0]
    sought.clear()
    monkeypatch.setattr(sweep, "KEPT", 0)
    anew = _task()
    others = anew.smoothed(smoothings)
    assert all(sought)
    near = task.apart <= 120.0
    for a, b in zip(kept, others, strict=True):
        assert np.allclose(a[near], b[near], rtol=1e-12, atol=1e-12)


def test_equations_are_solved_for_many_rows(monkeypatch):
    monkeypatch.setattr(sweep, "needed", lambda radius: 6)
    task = _task()
    scores = task.smoothed(((0, 0.0), (1, 0.5)))
    calls = []
    solve = sweep._gradient
    monkeypatch.setattr(sweep, "_gradient", lambda *given: calls.append(1) or solve(*given))
    monkeypatch.setattr(nb, "AT_ONCE", 1 << 11)
    rows = list(task.judged(scores, 4))
    # Two radii, two smoothings, three parts, however many blocks there are.
    assert len(calls) == 12 and sum(len(r["row"]) for r in rows) > 0


def test_a_method_is_one_search(spark, sf, monkeypatch):
    """Three methods and the agreement of all: four searches. Sums over halves give the whole field, and what is in neither half counts for it."""
    cfg = fx.config(min_holes=6)
    active = prepare_points(tables.intervals(fx.points(spark, sf)), cfg).active
    n = nb.nodes(active)
    key = F.substring("holej", 2, 9).cast("int") % 3
    whole = {r.i: r for r in nb.moments(n, cfg).collect()}
    parts = {r.i: r for r in nb.over_halves(nb.moments(n, cfg, split=F.when(key < 2, key).otherwise(-1))).collect()}
    assert whole.keys() == parts.keys() and whole
    for i, r in whole.items():
        assert r.local_n == parts[i].local_n and r.local_holes == parts[i].local_holes and np.isclose(r.mxx, parts[i].mxx, rtol=1e-9)
    searches = []
    found = nb.in_cells
    for module in (nb, validation):
        monkeypatch.setattr(module, "in_cells", lambda *given, **more: searches.append(1) or found(*given, **more))
    out = compare.compared(active, cfg)
    assert out.summary.count() == 3 and len(searches) == 4
