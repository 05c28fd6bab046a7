"""The queries in plain SQL, written independently of the DataFrame plans where relations are concerned: inequality joins in place of
grids, windows in place of two aggregations. Closed formulas of angles and eigenvalues are shared as text."""

from __future__ import annotations

from ..functions import vectors as v
from ..functions.matrices import SIX, eigenvalue_steps, eigenvector_steps, in_sql, solve_steps
from ..sources.columns import STANDARD
from . import fixtures as fx
from .sweep import RADII, SMOOTHINGS, needed

U: v.Vec = ("ux", "uy", "uz")
MISSING = "('-', '', 'NA', 'N/A', 'null', 'None', 'nan', 'NaN')"
SCORED = f"""points AS ({fx.POINTS}),
logs AS (SELECT *, ln(1 + greatest(assay, 0)) AS v FROM points),
scored AS (SELECT l.*, coalesce((v - m) / sd, 0) AS min_score FROM logs l, (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM logs) AS stats),
ranked AS (SELECT *, (rank() OVER (ORDER BY min_score) + (count(*) OVER (PARTITION BY min_score) - 1) / 2e0) / count(*) OVER () AS score_rank FROM scored),
active AS (SELECT * FROM ranked WHERE score_rank >= 0.5)"""
NODES = SCORED + ",\nn AS (SELECT src_index AS i, HoleID AS hole, Easting AS x, Northing AS y, Elevation AS z, min_score AS s, To_m - From_m AS len FROM active)"


def _edges(radius: float = 120, other: str = "a.hole <> b.hole") -> str:
    d2 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
    return NODES + f""",
e AS (SELECT a.i, a.s, b.i AS j, b.hole AS holej, b.s AS sj, b.len AS lenj, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, {d2} AS d2
  FROM n a JOIN n b ON {other} AND a.i <> b.i AND abs(b.x - a.x) <= {radius} AND {d2} <= {radius * radius} AND {d2} > 0)"""


def _weights(grade: str = "greatest(sj - (SELECT min(s) FROM n) + 1e-6, 1e-6)", decluster: bool = True, edges: str | None = None) -> str:
    w = "w0 * max(near_term) OVER h / sum(w0) OVER h" if decluster else "w0"
    return (edges or _edges()) + f""",
w AS (SELECT *, {w} AS w FROM (SELECT *, {grade} * near_term * greatest(lenj, 0.1) AS w0 FROM (SELECT *, exp(-d2 / 12800e0) AS near_term FROM e) AS t0) AS t1 WINDOW h AS (PARTITION BY i, holej))"""


UNGRADED = _weights("1e0")
COUNTS = "count(*)::BIGINT AS local_n, count(DISTINCT holej)::BIGINT AS local_holes"


def _covariance(keys: str = "i", table: str = "w") -> str:
    sums = ", ".join(f"sum(w * d{k[0]} * d{k[1]}) / sum(w) - sum(w * d{k[0]}) / sum(w) * sum(w * d{k[1]}) / sum(w) AS t{k}" for k in SIX)
    return f"(SELECT {keys}, {COUNTS}, {sums} FROM {table} GROUP BY {keys})"


def _r(expr: str, digits: int, name: str | None = None) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def _eigen(source: str, p: str = "t") -> str:
    return in_sql(source, [*eigenvalue_steps(p), *eigenvector_steps(p, f"{p}l1", "v1"), *eigenvector_steps(p, f"{p}l3", "v3")])


GATED = f"(SELECT * FROM {_covariance()} AS c WHERE local_n >= 10 AND local_holes >= 3)"
V1: v.Vec = ("v1x", "v1y", "v1z")
V3: v.Vec = ("v3x", "v3y", "v3z")
G: v.Vec = ("gx", "gy", "gz")
SHAPE = f"shape AS (SELECT * FROM {_eigen(GATED)} AS f)"


def _lsq() -> str:
    d = "sqrt(d2)"
    delta = f"((sj - s) / {d})"
    sums = ", ".join(f"sum(w * d{k[0]} * d{k[1]} / d2) / sum(w) AS a{k}" for k in SIX)
    sums += ", " + ", ".join(f"sum(w * {delta} * d{c} / {d}) / sum(w) AS rh{c}" for c in "xyz") + f", sum(w * {delta} * {delta}) / sum(w) AS c"
    base = f"(SELECT * FROM (SELECT i, {COUNTS}, {sums} FROM w GROUP BY i) AS m WHERE local_n >= 10 AND local_holes >= 3)"
    solved = in_sql(base, [*eigenvalue_steps("a"), *solve_steps("a", "rh", 1e-3, "g")])
    fit = " + ".join(f"{1 if k[0] == k[1] else 2} * g{k[0]} * g{k[1]} * a{k}" for k in SIX)
    size = "sqrt(gx * gx + gy * gy + gz * gz)"
    return f"""lsq AS (SELECT *, {size} AS gradient_magnitude, CASE WHEN al1 > 0 THEN al3 / al1 ELSE 0 END AS sampling_conditioning,
  CASE WHEN c > 0 THEN greatest(0, least(1, (2 * (gx * rhx + gy * rhy + gz * rhz) - ({fit})) / c)) ELSE 1 END AS planarity FROM {solved} AS g WHERE {size} > 0)"""


def _desurvey(depths: str) -> str:
    x, y, z = v.direction("Dip", "Azimuth")
    ux, uy, uz = v.unit(("qx", "qy", "qz"))
    mix = lambda c: f"coalesce(a{c}, f{c}) + t * (coalesce(f{c}, a{c}) - coalesce(a{c}, f{c}))"
    back = ", ".join(f"last_value(CASE WHEN x IS NOT NULL THEN {c} END IGNORE NULLS) OVER (PARTITION BY HoleID ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a{c}" for c in ("d", "x", "y", "z"))
    ahead = ", ".join(f"first_value(CASE WHEN x IS NOT NULL THEN {c} END IGNORE NULLS) OVER (PARTITION BY HoleID ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f{c}" for c in ("d", "x", "y", "z"))
    prev = ", ".join(f"lag({c}) OVER (PARTITION BY HoleID ORDER BY d) AS p{c}" for c in ("d", "ux", "uy", "uz"))
    step = "0.5e0 * (d - pd) * CASE WHEN bend < 1e-12 THEN 1 ELSE 2 / bend * tan(bend / 2) END"
    run = ", ".join(f"sum(coalesce({step} * (u{c} + pu{c}), 0)) OVER (PARTITION BY HoleID ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m{c}" for c in "xyz")
    return f"""points AS ({fx.POINTS}), collars AS ({fx.COLLARS}), given AS ({fx.SURVEYS}),
surveys AS (SELECT * FROM given UNION ALL SELECT HoleID, 0e0, Dip, Azimuth FROM collars WHERE HoleID NOT IN (SELECT HoleID FROM given WHERE Depth_m <= 0)),
dirs AS (SELECT HoleID, Depth_m AS d, {x} AS x, {y} AS y, {z} AS z FROM surveys),
depths AS (SELECT DISTINCT HoleID, d FROM ({depths}) AS asked UNION SELECT HoleID, d FROM dirs),
every AS (SELECT HoleID, d, x, y, z FROM depths LEFT JOIN dirs USING (HoleID, d)),
near_by AS (SELECT HoleID, d, {back}, {ahead} FROM every),
mixed AS (SELECT *, CASE WHEN fd > ad THEN (d - ad) / (fd - ad) ELSE 0 END AS t FROM near_by),
raw AS (SELECT HoleID, d, {', '.join(f'{mix(c)} AS q{c}' for c in 'xyz')} FROM mixed),
units AS (SELECT HoleID, d, {ux} AS ux, {uy} AS uy, {uz} AS uz FROM raw),
bent AS (SELECT *, acos(greatest(-1, least(1, ux * pux + uy * puy + uz * puz))) AS bend FROM (SELECT *, {prev} FROM units) AS lagged),
moved AS (SELECT *, {run} FROM bent),
path AS MATERIALIZED (SELECT HoleID, d AS Depth_m, Easting + mx AS X, Northing + my AS Y, Elevation + mz AS Z, ux, uy, uz FROM moved JOIN collars USING (HoleID))"""


THREE = "SELECT HoleID, From_m AS d FROM points UNION ALL SELECT HoleID, To_m FROM points UNION ALL SELECT HoleID, 0.5e0 * (From_m + To_m) FROM points"
PICKS = "SELECT HoleID, event_type AS code, min(From_m) AS top, max(To_m) AS base FROM points GROUP BY ALL"
CONTACTS = _desurvey(f"SELECT HoleID, top AS d FROM ({PICKS}) AS p1 UNION ALL SELECT HoleID, base FROM ({PICKS}) AS p2") + f""",
ends AS (SELECT HoleID, code, 'top' AS boundary, top AS Depth_m FROM ({PICKS}) AS p3 UNION ALL SELECT HoleID, code, 'base', base FROM ({PICKS}) AS p4),
contacts AS (SELECT HoleID, code, boundary, Depth_m AS depth_m, X AS x, Y AS y, Z AS z FROM ends JOIN path USING (HoleID, Depth_m))"""
_COV = ", ".join(f"avg((p.{k[0]} - c{k[0]}) * (p.{k[1]} - c{k[1]})) AS t{k}" for k in SIX)
PLANES_SQL = CONTACTS + f""",
centres AS (SELECT code, boundary, count(*) AS n_holes, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) AS extent_m
  FROM contacts GROUP BY ALL HAVING count(*) >= 8),
cov AS (SELECT c.code, c.boundary, n_holes, cx, cy, cz, extent_m, {_COV} FROM contacts p JOIN centres c ON p.code = c.code AND p.boundary = c.boundary GROUP BY ALL),
planes AS (SELECT *, sqrt(greatest((txx + tyy) / 2 - sqrt(power((txx - tyy) / 2, 2) + txy * txy), 0) / ((txx + tyy) / 2 + sqrt(power((txx - tyy) / 2, 2) + txy * txy))) AS collar_aspect FROM {_eigen('cov')} AS e)"""

S1, S2, S3 = (f"greatest(tl{k}, 1e-12)" for k in (1, 2, 3))
VECTORS = "vecs AS (SELECT vec_id, label, embedding[1]::DOUBLE AS vx, embedding[2]::DOUBLE AS vy, embedding[3]::DOUBLE AS vz FROM embeddings)"
UNITS = VECTORS + ", u AS (SELECT vec_id, label, " + ", ".join(f"{e} AS {c}" for c, e in zip(U, v.unit(("vx", "vy", "vz")), strict=True)) + " FROM vecs)"


def _angles(**made: str) -> str:
    return f"WITH {UNITS} SELECT vec_id, " + ", ".join(_r(e, 6, k) for k, e in made.items()) + " FROM u"


def _smooth(rounds: int, alpha: float) -> str:
    out = f"WITH {_weights()}, s0 AS (SELECT i, s FROM n)"
    for k in range(rounds):
        out += f", s{k + 1} AS (SELECT a.i, CASE WHEN m.i IS NULL THEN a.s ELSE {1 - alpha} * a.s + {alpha} * m.s END AS s FROM s{k} a LEFT JOIN (SELECT w.i, sum(w.w * b.s) / sum(w.w) AS s FROM w JOIN s{k} b ON w.j = b.i GROUP BY w.i) m ON a.i = m.i)"
    return out + f" SELECT i, {_r('s', 6)} FROM s{rounds}"


def _smooth_tensors(rounds: int) -> str:
    cols = [f"t{k}" for k in SIX]
    out = f"WITH {_weights()}, t0 AS (SELECT i, {', '.join(cols)} FROM {_covariance()} AS c)"
    for k in range(rounds):
        means = ", ".join(f"sum(w.w * b.{c}) AS {c}" for c in cols)
        out += f", t{k + 1} AS (SELECT a.i, {', '.join(f'(a.{c} + coalesce(m.{c}, 0)) / (1 + coalesce(m.ws, 0)) AS {c}' for c in cols)} FROM t0 a LEFT JOIN (SELECT w.i, sum(w.w) AS ws, {means} FROM w JOIN t{k} b ON w.j = b.i GROUP BY w.i) m ON a.i = m.i)"
    return out + f" SELECT i, {', '.join(_r(c, 4) for c in cols)} FROM t{rounds}"


def _edge_sums(edges: str) -> str:
    return f"WITH {edges} SELECT i, count(*) AS n, sum(j)::BIGINT AS sum_j, {_r('sum(sqrt(d2))', 5, 'sum_d')} FROM e GROUP BY i"


def _weight_sums(weights: str) -> str:
    return f"WITH {weights} SELECT i, holej, count(*) AS n, {_r('sum(w)', 6, 'sum_w')}, {_r('max(w)', 6, 'max_w')} FROM w GROUP BY i, holej"


def _poles(cte: str, vec: v.Vec) -> str:
    return f"SELECT i, {', '.join(f'{e} AS p{c}' for c, e in zip('xyz', vec, strict=True))} FROM {cte}"


_ANGLE = v.angle(("a.px", "a.py", "a.pz"), ("b.px", "b.py", "b.pz"))
_UNIT_G = tuple(f"({c} / gradient_magnitude)" for c in G)
RAW = f"raw AS ({fx.RAW}), typed AS (SELECT src_index, BHID AS HoleID, LowRecovery, " + ", ".join(f'CASE WHEN "{a}" IN {MISSING} THEN NULL ELSE try_cast("{a}" AS DOUBLE) END AS {b}' for a, b in (("From", "From_m"), ("To", "To_m"), ("assay", "assay"), ("X", "Easting"), ("Y", "Northing"), ("Z", "Elevation"))) + " FROM raw), loaded AS (SELECT *, To_m - From_m AS interval_m, 0.5e0 * (From_m + To_m) AS mid_m FROM typed WHERE To_m - From_m > 0 AND Easting IS NOT NULL AND Northing IS NOT NULL AND Elevation IS NOT NULL)"
_SOURCES = {"HoleID": "BHID", "From_m": "From", "To_m": "To", "Easting": "X", "Northing": "Y", "Elevation": "Z"}


def _comparison() -> str:
    w, rest = _weights(), PLANES_SQL.split("collars AS", 1)[1]
    ungraded = UNGRADED[len(_edges()) :].replace("\nw AS", "\nwu AS")
    shape_u = f"shape_u AS (SELECT * FROM {_eigen(f'(SELECT * FROM {_covariance(table="wu")} AS c WHERE local_n >= 10 AND local_holes >= 3)')} AS f)"
    fields = "fields AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({_poles(t, p)}) AS q{k}" for k, (m, t, p) in enumerate((("shape_pca", "shape", V3), ("lsq_gradient", "lsq", _UNIT_G), ("drill_pattern", "shape_u", V3)))) + ")"
    near = "(n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y) + (n.z - c.z) * (n.z - c.z) <= 10000"
    return f"""{w}{ungraded}, {SHAPE}, {_lsq()}, {shape_u}, {fields}, collars AS{rest},
close_by AS (SELECT DISTINCT c.code, c.boundary, n.i FROM contacts c JOIN planes p ON c.code = p.code AND c.boundary = p.boundary AND p.collar_aspect >= 0.15 JOIN n ON {near}),
angles AS (SELECT a.method, k.code, k.boundary, b.n_holes, {v.angle(("a.px", "a.py", "a.pz"), ("b.v3x", "b.v3y", "b.v3z"))} AS g FROM close_by k JOIN fields a ON a.i = k.i JOIN planes b ON b.code = k.code AND b.boundary = k.boundary),
compared AS (SELECT method, code, boundary, n_holes, count(*) AS n_nodes, median(g) AS median_err_deg, quantile_cont(g, 0.25) AS p25_err_deg FROM angles GROUP BY ALL HAVING count(*) >= 20)"""


def _method_summary() -> str:
    """The fields as in _comparison; each statistic by method."""
    w = _weights()
    ungraded = UNGRADED[len(_edges()) :].replace("\nw AS", "\nwu AS")
    wu = _covariance(table="wu")
    shape_u = f"shape_u AS (SELECT * FROM {_eigen(f'(SELECT * FROM {wu} AS c WHERE local_n >= 10 AND local_holes >= 3)')} AS f)"
    norms = lambda t: f"greatest(0, least(1, (tl2 - tl3) / tl1)) AS plane, greatest(0, least(1, (tl1 - tl2) / tl1)) AS line FROM {t}"
    every = f"""every AS (SELECT 'shape_pca' AS method, i, {', '.join(f'{e} AS p{c}' for c, e in zip('xyz', V3, strict=True))}, {norms('shape')}
  UNION ALL SELECT 'lsq_gradient', i, {', '.join(_UNIT_G)}, planarity, 0e0 FROM lsq
  UNION ALL SELECT 'drill_pattern', i, {', '.join(V3)}, {norms('shape_u')})"""
    dealt = f"""dealt AS (SELECT a.method, a.i, {', '.join(f'b.p{c}' for c in 'xyz')} FROM (SELECT method, i, row_number() OVER (PARTITION BY method ORDER BY md5(i::VARCHAR), i) AS k FROM every) a
  JOIN (SELECT method, px, py, pz, row_number() OVER (PARTITION BY method ORDER BY md5('0/' || i), i) AS k FROM every) b USING (method, k))"""
    agreed = lambda t: f"(SELECT method, median(m) AS deg FROM (SELECT a.method, e.i, median({_ANGLE}) AS m FROM e JOIN {t} a ON e.i = a.i JOIN {t} b ON e.j = b.i AND a.method = b.method GROUP BY a.method, e.i) AS q GROUP BY method)"
    tensor = lambda t: f"(SELECT method, count(*) AS n, {', '.join(f'avg(p{k[0]} * p{k[1]}) AS t{k}' for k in SIX)} FROM {t} GROUP BY method)"
    woodcock = lambda t: f"(SELECT method, {S1} AS S1, {S2} AS S2, {S3} AS S3 FROM {in_sql(tensor(t), eigenvalue_steps('t'))} AS q)"
    half = "ascii(md5('0/' || holej)) % 2"

    def halves(table: str, name: str) -> str:
        t = _covariance(f"i, {half}", table).replace(f"SELECT i, {half},", f"SELECT i, {half} AS half,")
        return f"{name} AS (SELECT i, half, v3x AS px, v3y AS py, v3z AS pz FROM {_eigen(f'(SELECT * FROM {t} AS c WHERE local_n >= 5 AND local_holes >= 1)')} AS f)"

    lsq = _lsq().replace("lsq AS (", "half_l AS (").replace("SELECT i, count(*)", f"SELECT i, {half} AS half, count(*)").replace("FROM w GROUP BY i)", f"FROM w GROUP BY i, {half})").replace("local_n >= 10 AND local_holes >= 3", "local_n >= 5 AND local_holes >= 1")
    stable = "UNION ALL ".join(f"SELECT '{m}' AS method, {_ANGLE} AS deg FROM {t} a JOIN {t} b ON a.i = b.i AND a.half = 0 AND b.half = 1 " for m, t in (("shape_pca", "half_g"), ("lsq_gradient", "half_p"), ("drill_pattern", "half_u")))
    return f"""WITH {w}{ungraded}, {SHAPE}, {_lsq()}, {shape_u}, {every}, {dealt}, {halves('w', 'half_g')}, {halves('wu', 'half_u')}, {lsq},
half_p AS (SELECT i, half, {', '.join(f'{e} AS p{c}' for c, e in zip('xyz', _UNIT_G, strict=True))} FROM half_l), stable AS ({stable}),
truth AS ({fx.TRUTH}), cuts AS (SELECT method, quantile_cont(plane, 0.75) AS cut FROM every GROUP BY method),
sure AS (SELECT every.* FROM every JOIN cuts USING (method) WHERE plane >= cut),
base AS (SELECT method, count(*) AS n_valid, median(plane) AS planarity_norm_med, median(line) AS linearity_norm_med FROM every GROUP BY method)
SELECT method, CASE WHEN method = 'drill_pattern' THEN 'reference' ELSE 'method' END AS role, n_valid, {_r('100e0 * n_valid / (SELECT count(*) FROM active)', 6, 'pct_active')}, {_r('planarity_norm_med', 6)}, {_r('linearity_norm_med', 6)},
{_r('wa.S1', 6, 'S1_all')}, {_r('ln(wa.S1 / wa.S3)', 5, 'C_all')}, {_r('ln(wa.S1 / wa.S2) / ln(wa.S2 / wa.S3)', 4, 'K_all')}, {_r('ws.S1', 6, 'S1_conf')}, {_r('ln(ws.S1 / ws.S3)', 5, 'C_conf')},
{_r('vs.deg', 3, 'vs_reference_deg')}, {_r('t.deg', 3, 'true_err_deg')}, {_r('co.deg', 3, 'coherence_deg')}, {_r('nu.deg', 3, 'coherence_null_deg')}, {_r('st.deg', 3, 'stability_deg')}, n_stability
FROM base JOIN {woodcock('every')} AS wa USING (method) JOIN {woodcock('sure')} AS ws USING (method)
LEFT JOIN (SELECT a.method, median({_ANGLE}) AS deg FROM every a JOIN every b ON a.i = b.i AND b.method = 'drill_pattern' AND a.method <> 'drill_pattern' GROUP BY a.method) AS vs USING (method)
LEFT JOIN (SELECT a.method, median({v.angle(("a.px", "a.py", "a.pz"), ("b.true_pole_x", "b.true_pole_y", "b.true_pole_z"))}) AS deg FROM every a JOIN truth b ON a.i = b.src_index GROUP BY a.method) AS t USING (method)
LEFT JOIN {agreed('every')} AS co USING (method) LEFT JOIN {agreed('dealt')} AS nu USING (method)
LEFT JOIN (SELECT method, median(deg) AS deg, count(*) AS n_stability FROM stable GROUP BY method) AS st USING (method)"""


def _table_route() -> str:
    """The field of samples placed by their holes' paths; scores are those of the points, which have the same assays."""
    nodes = "n AS (SELECT a.src_index AS i, a.HoleID AS hole, X AS x, Y AS y, Z AS z, min_score AS s, To_m - From_m AS len FROM active a JOIN path p ON p.HoleID = a.HoleID AND p.Depth_m = 0.5e0 * (a.From_m + a.To_m))"
    scored = SCORED.split("logs AS", 1)[1]
    edges = _edges().split(NODES, 1)[1]
    strike, dip = v.strike(V3), v.dip(V3)
    return f"WITH {_desurvey(THREE)}, logs AS{scored}, {nodes}{_weights(edges=edges)}, {SHAPE} SELECT i AS src_index, {_r(strike, 3, 'plane_strike_deg')}, {_r(dip, 3, 'plane_dip_deg')}, local_n, local_holes FROM shape"


def _sweep() -> str:
    """Case by case, pair by pair: weights in windows, scores round by round, gradients from differences of the two samples' scores."""
    ctes = [_edges(max(RADII)).replace("\ne AS (", "\ne AS MATERIALIZED (")]
    cases, patterns, least = [], [], "greatest(sj - (SELECT min(s) FROM n) + 1e-6, 1e-6)"
    for q, r in enumerate(RADII):
        near_term = f"exp(-d2 / {2 * (0.67 * r) ** 2!r})"
        spread = lambda w: f"{w} * max(near_term) OVER h / sum({w}) OVER h"
        ctes.append(f"""w{q} AS MATERIALIZED (SELECT i, j, holej, ascii(md5('0/' || holej)) % 2 AS half, dx, dy, dz, d2, {spread('w0')} AS w, {spread('u0')} AS u
  FROM (SELECT *, {near_term} AS near_term, {least} * {near_term} * greatest(lenj, 0.1) AS w0, {near_term} * greatest(lenj, 0.1) AS u0 FROM e WHERE d2 <= {r * r}) AS t WINDOW h AS (PARTITION BY i, holej))""")
        ctes.append(f"f{q}_0_0 AS (SELECT i, s AS s_a, s AS s_0, s AS s_1 FROM n)")
        for alpha, rounds in ((0.5, 2), (0.7, 5)):
            for k in range(1, rounds + 1):
                before, name = (f"f{q}_{int(10 * alpha)}_{k - 1}" if k > 1 else f"f{q}_0_0"), f"f{q}_{int(10 * alpha)}_{k}"
                sums = ", ".join(f"sum(w.w){f} AS t{p}, sum(w.w * b.s_{p}){f} AS m{p}" for p, f in (("a", ""), ("0", " FILTER (WHERE half = 0)"), ("1", " FILTER (WHERE half = 1)")))
                moved = ", ".join(f"CASE WHEN t{p} > 0 THEN {1 - alpha} * a.s_{p} + {alpha} * m{p} / t{p} ELSE a.s_{p} END AS s_{p}" for p in "a01")
                ctes.append(f"{name} AS MATERIALIZED (SELECT a.i, {moved} FROM {before} a LEFT JOIN (SELECT w.i, {sums} FROM w{q} w JOIN {before} b ON w.j = b.i GROUP BY w.i) m ON a.i = m.i)")
        for rounds, alpha in SMOOTHINGS:
            state, smooth = f"f{q}_{int(10 * alpha)}_{rounds}", f"{rounds}x{alpha}"
            for part, key in (("'all'", "a"), ("half::VARCHAR", None)):
                delta = "((b.s_a - a.s_a) / sqrt(d2))" if key else "(CASE half WHEN 0 THEN b.s_0 - a.s_0 ELSE b.s_1 - a.s_1 END / sqrt(d2))"
                sums = ", ".join(f"sum(w * d{k[0]} * d{k[1]} / d2) / sum(w) AS a{k}" for k in SIX) + ", " + ", ".join(f"sum(w * {delta} * d{c} / sqrt(d2)) / sum(w) AS rh{c}" for c in "xyz")
                n_least, h_least = (needed(r), 6) if key else (needed(r) // 2, 3)
                cases.append(f"SELECT {r}::DOUBLE AS radius, '{smooth}' AS smooth, {part} AS part, w.i, {sums}, sum(w * {delta} * {delta}) / sum(w) AS c FROM w{q} w JOIN {state} a ON a.i = w.i JOIN {state} b ON b.i = w.j GROUP BY w.i{'' if key else ', half'} HAVING count(*) >= {n_least} AND count(DISTINCT holej) >= {h_least}")
        t = _covariance(table=f"(SELECT * EXCLUDE (w), u AS w FROM w{q})")
        patterns.append(f"SELECT {r}::DOUBLE AS radius, * FROM {t} AS t WHERE local_n >= {needed(r)} AND local_holes >= 6")
    solved = in_sql("cases", [*eigenvalue_steps("a"), *solve_steps("a", "rh", 1e-3, "g")])
    fit = " + ".join(f"{1 if k[0] == k[1] else 2} * g{k[0]} * g{k[1]} * a{k}" for k in SIX)
    size, rest = "sqrt(gx * gx + gy * gy + gz * gz)", PLANES_SQL.split("collars AS", 1)[1]
    close = "(n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y) + (n.z - c.z) * (n.z - c.z) <= 10000"
    ctes += [
        "cases AS (" + "\nUNION ALL ".join(cases) + ")", "patterns AS (" + "\nUNION ALL ".join(patterns) + ")",
        f"""field AS MATERIALIZED (SELECT radius, smooth, part, i, gx / {size} AS px, gy / {size} AS py, gz / {size} AS pz, CASE WHEN al1 > 0 THEN al3 / al1 ELSE 0 END AS cond,
  CASE WHEN c > 0 THEN greatest(0, least(1, (2 * (gx * rhx + gy * rhy + gz * rhz) - ({fit})) / c)) ELSE 1 END AS r2 FROM {solved} AS g WHERE {size} > 0)""",
        f"drill AS MATERIALIZED (SELECT radius, i, v3x AS px, v3y AS py, v3z AS pz FROM {_eigen('patterns')} AS f)", "whole AS (SELECT * FROM field WHERE part = 'all')", f"collars AS{rest}",
        f"close_by AS MATERIALIZED (SELECT DISTINCT c.code, c.boundary, n.i FROM contacts c JOIN planes p ON c.code = p.code AND c.boundary = p.boundary AND p.collar_aspect >= 0.15 JOIN n ON {close})",
        f"surfaces AS (SELECT a.radius, a.smooth, k.code, k.boundary, count(*) AS m, median({v.angle(('a.px', 'a.py', 'a.pz'), ('b.v3x', 'b.v3y', 'b.v3z'))}) AS deg FROM close_by k JOIN whole a ON a.i = k.i JOIN planes b ON b.code = k.code AND b.boundary = k.boundary GROUP BY ALL HAVING count(*) >= 20)",
    ]
    least = "CASE radius " + " ".join(f"WHEN {r} THEN {needed(r)}" for r in RADII) + " END::BIGINT"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT radius, {least} AS min_n, smooth, n_valid, {_r('contact_err', 3)}, {_r('stability', 3)}, {_r('vs_reference', 3)}, {_r('r2_med', 3)}, {_r('cond_med', 3)}
FROM (SELECT radius, smooth, count(*) AS n_valid, median(r2) AS r2_med, median(cond) AS cond_med FROM whole GROUP BY ALL) AS base
JOIN (SELECT a.radius, a.smooth, median({_ANGLE}) AS vs_reference FROM whole a JOIN drill b ON a.i = b.i AND a.radius = b.radius GROUP BY ALL HAVING count(*) >= 300) AS vs USING (radius, smooth)
JOIN (SELECT radius, smooth, sum(m * deg) / sum(m) AS contact_err FROM surfaces GROUP BY ALL) AS errors USING (radius, smooth)
LEFT JOIN (SELECT a.radius, a.smooth, median({_ANGLE}) AS stability FROM field a JOIN field b ON a.i = b.i AND a.radius = b.radius AND a.smooth = b.smooth AND a.part = '0' AND b.part = '1' GROUP BY ALL) AS stable USING (radius, smooth)"""


def sql() -> dict[str, str]:
    li = "lineitem"
    half = "CAST(substr(holej, 2) AS INT) % 2"
    halved = lambda half: f"(SELECT * FROM {_covariance(f'i, {half}').replace(f'SELECT i, {half},', f'SELECT i, {half} AS half,')} AS c WHERE local_n >= 5 AND local_holes >= 3)"
    halves, halves_random = halved(half), halved("ascii(md5('7/' || holej)) % 2")
    six = ", ".join(_r(f"t{k}", 4) for k in SIX)
    x, y = v.equal_area(v.trend(V3), v.plunge(V3))
    # A fold of 400 m along x that plunges by 10 degrees along y, its shell at 930 m and 30 m high.
    turn, fall = "(2e0 * pi() / 400e0)", "tan(radians(10e0))"
    slope, middle = f"(-30e0 * {turn} * sin({turn} * (Easting - 10000e0)))", f"(930e0 + 30e0 * cos({turn} * (Easting - 10000e0)) - (Northing - 10000e0) * {fall})"
    fold = f"""fold AS (SELECT *, 0.02e0 + 1.8e0 * exp(-0.5e0 * (away / 25e0) * (away / 25e0)) AS grade, -sx / size AS nx, {fall} / size AS ny, 1 / size AS nz
  FROM (SELECT *, (Elevation - {middle}) / size AS away FROM (SELECT src_index, Easting, Northing, Elevation, {slope} AS sx, sqrt(1 + {slope} * {slope} + {fall} * {fall}) AS size FROM ({fx.POINTS}) AS p) AS t1) AS t2)"""
    ex, ey = v.equal_area(v.trend(U), v.plunge(U))
    nx, ny, nz = v.normal(v.strike(U), v.dip(U))
    strike, dip = v.strike(V3), v.dip(V3)
    pitch = v.pitch("strike", "dip", V1)
    out = {
        "alias_preview": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {repr(_SOURCES[s]) if s in _SOURCES else 'NULL'}, {str(s in _SOURCES).lower()}, '{'ok' if s in _SOURCES else '-'}')" for s in STANDARD.values()) + ") AS t(internal, source, required, status)",
        "ingest_points": f"WITH {RAW} SELECT src_index, HoleID, From_m, To_m, mid_m, interval_m, assay, Easting, Northing, Elevation FROM loaded",
        "filter_low_recovery": f"WITH {RAW} SELECT src_index, assay FROM loaded WHERE upper(coalesce(LowRecovery, 'N')) <> 'Y'",
        "filter_property_hole": f"SELECT src_index, HoleID FROM ({fx.POINTS}) AS p WHERE HoleID IN (SELECT HoleID FROM ({fx.COLLARS}) AS c WHERE Property IN ('P1', 'P2') AND HoleID IN ({', '.join(repr(f'H{k}') for k in range(0, 60, 2))}))",
        "score_single": f"WITH {SCORED} SELECT src_index, {_r('min_score', 6)}, {_r('score_rank', 9)}, score_rank >= 0.5 AS is_active FROM ranked",
        "score_multi": f"""WITH points AS ({fx.POINTS}), logs AS (SELECT src_index, ln(1 + greatest(assay, 0)) AS a, ln(1 + CAST(src_index % 101 AS DOUBLE)) AS b FROM points),
scored AS (SELECT src_index, ((a - ma) / sa + (b - mb) / sb) / 2 AS min_score FROM logs, (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM logs) AS st),
ranked AS (SELECT *, (rank() OVER (ORDER BY min_score) + (count(*) OVER (PARTITION BY min_score) - 1) / 2e0) / count(*) OVER () AS score_rank FROM scored)
SELECT src_index, {_r('min_score', 6)}, {_r('score_rank', 9)}, score_rank >= 0.85 AS is_active FROM ranked""",
        "score_rank_ties": f"SELECT q, {_r('max(r)', 9, 'rank')}, count(*) AS n FROM (SELECT CAST(l_quantity AS DOUBLE) AS q, (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0) / count(*) OVER () AS r FROM {li}) AS t GROUP BY q",
        "active_nodes": f"WITH {SCORED} SELECT src_index, HoleID, Easting AS mid_x, Northing AS mid_y, Elevation AS mid_z FROM active",
        "active_curve": f"WITH {SCORED} SELECT k / 100e0 AS quantile, (SELECT count(*) FROM ranked WHERE round(score_rank * 100, 9) >= k)::BIGINT AS count FROM generate_series(0, 100) AS g(k)",
        "column_stats": f"""WITH raw AS ({fx.RAW}), long AS (SELECT 'assay' AS "column", CASE WHEN assay IN {MISSING} THEN NULL ELSE try_cast(assay AS DOUBLE) END AS v FROM raw UNION ALL SELECT 'Y', CASE WHEN Y IN {MISSING} THEN NULL ELSE try_cast(Y AS DOUBLE) END FROM raw)
SELECT "column", count(v) AS n, count(*) - count(v) AS n_null, min(v) AS min, {_r('median(v)', 6, 'median')}, max(v) AS max, {_r('avg(v)', 6, 'mean')} FROM long GROUP BY "column\"""",
        "extent": f"SELECT {', '.join(f'{f}({c}) AS {f}_{c}' for c in ('Easting', 'Northing', 'Elevation') for f in ('min', 'max'))}, count(DISTINCT HoleID) AS n_holes, count(*) AS n FROM ({fx.POINTS}) AS p",
        "rim_exposure": f"WITH points AS ({fx.POINTS}), box AS (SELECT min(Easting) AS x0, max(Easting) AS x1, min(Northing) AS y0, max(Northing) AS y1 FROM points) SELECT count(*) AS n, (count(*) FILTER (WHERE Easting - x0 < 120 OR x1 - Easting < 120 OR Northing - y0 < 120 OR y1 - Northing < 120))::BIGINT AS n_rim, round((count(*) FILTER (WHERE Easting - x0 < 120 OR x1 - Easting < 120 OR Northing - y0 < 120 OR y1 - Northing < 120)) / count(*)::DOUBLE, 9) + 0.0 AS share FROM points, box",
        "hole_code": f"WITH {SCORED} SELECT HoleID, (row_number() OVER (ORDER BY min(src_index)) - 1)::BIGINT AS hole_code FROM active GROUP BY HoleID",
        "desurvey_path": f"WITH {_desurvey(THREE)} SELECT HoleID, Depth_m, {', '.join(_r(c, 5) for c in 'XYZ')}, {', '.join(_r(c, 6) for c in U)} FROM path",
        "desurvey_samples": f"WITH {_desurvey(THREE)}, sought AS (SELECT src_index, HoleID, unnest(['from', 'to', 'mid']) AS role, unnest([From_m, To_m, 0.5e0 * (From_m + To_m)]) AS Depth_m FROM points), found AS (SELECT * FROM sought JOIN path USING (HoleID, Depth_m)) SELECT src_index, HoleID, " + ", ".join(_r(f"max({c}) FILTER (WHERE role = '{t}')", 5, f"{t}_{c.lower()}") for t in ("from", "to", "mid") for c in "XYZ") + f""", {', '.join(_r(f"max({c}) FILTER (WHERE role = 'mid')", 6, c) for c in U)}, max(Length_m) AS hole_length_m
FROM found JOIN collars USING (HoleID) GROUP BY src_index, HoleID""",
        "table_route": _table_route(),
        "hole_traces": f"SELECT HoleID, count(*) AS n, arg_min(Easting, From_m) AS x0, arg_max(Elevation, From_m) AS z1 FROM ({fx.POINTS}) AS p GROUP BY HoleID",
        "edges_radius": _edge_sums(_edges()),
        "edges_same_hole_included": _edge_sums(_edges(60, "true")),
        "edge_weights_declustered": _weight_sums(_weights()),
        "edge_weights_raw": _weight_sums(_weights(decluster=False)),
        "edge_weights_ungraded": _weight_sums(UNGRADED),
        "neighbor_counts": f"WITH {_edges()} SELECT i, {COUNTS} FROM e GROUP BY i",
        "gate_diagnosis": f"WITH {_edges()}, k AS (SELECT n.i, count(e.j) AS c, count(DISTINCT e.holej) AS h FROM n LEFT JOIN e ON n.i = e.i GROUP BY n.i) SELECT count(*) AS n_active, median(c)::DOUBLE AS median_local_n, quantile_cont(c::DOUBLE, 0.1) AS p10_local_n, max(c)::BIGINT AS max_local_n, count(*) FILTER (WHERE c < 300) AS failed_local_n, median(h)::DOUBLE AS median_local_holes, count(*) FILTER (WHERE h < 3) AS failed_local_holes FROM k",
        "shape_pca_tensor": f"WITH {_weights()} SELECT i, local_n, local_holes, {six} FROM {GATED} AS g",
        "shape_pca_field": f"""WITH {_weights()}, {SHAPE} SELECT i AS src_index, 'shape_pca' AS estimator, {', '.join(_r(f'tl{k}', 3, f'eig{k}') for k in (1, 2, 3))}, {_r('(tl2 - tl3) / tl1', 6, 'planarity')}, {_r('(tl1 - tl2) / tl1', 6, 'linearity')},
{', '.join(_r(e, 4, k) for k, e in (('line_trend_deg', v.trend(V1)), ('line_plunge_deg', v.plunge(V1)), ('pole_trend_deg', v.trend(V3)), ('pole_plunge_deg', v.plunge(V3)), ('plane_strike_deg', strike), ('plane_dip_deg', dip)))}, local_n, local_holes FROM shape""",
        "lsq_gradient_field": f"""WITH {_weights()}, {_lsq()}, p AS (SELECT *, {', '.join(f'{e} AS p{c}' for c, e in zip('xyz', _UNIT_G, strict=True))} FROM lsq) SELECT i AS src_index,
{', '.join(_r(e, 3, k) for k, e in (('pole_trend_deg', v.trend(('px', 'py', 'pz'))), ('pole_plunge_deg', v.plunge(('px', 'py', 'pz'))), ('plane_strike_deg', v.strike(('px', 'py', 'pz'))), ('plane_dip_deg', v.dip(('px', 'py', 'pz')))))},
{_r('planarity', 6)}, {_r('sampling_conditioning', 6)}, {_r('gradient_magnitude', 6)}, local_n, local_holes FROM p""",
        "drill_pattern_field": f"WITH {UNGRADED}, {SHAPE} SELECT i AS src_index, {_r(strike, 4, 'plane_strike_deg')}, {_r(dip, 4, 'plane_dip_deg')}, {_r('(tl2 - tl3) / tl1', 6, 'planarity')} FROM shape",
        "vs_reference": f"WITH {_weights()}{UNGRADED[len(_edges()):].replace(chr(10) + 'w AS', chr(10) + 'wu AS')}, {SHAPE}, shape_u AS (SELECT * FROM {_eigen('(SELECT * FROM ' + _covariance(table='wu') + ' AS c WHERE local_n >= 10 AND local_holes >= 3)')} AS f) SELECT a.i AS src_index, {_r(_ANGLE, 4, 'vs_reference_deg')} FROM ({_poles('shape', V3)}) a JOIN ({_poles('shape_u', V3)}) b ON a.i = b.i",
        "export_table": f"""WITH {_weights()}, {SHAPE}, f AS (SELECT *, {strike} AS strike, {dip} AS dip FROM shape)
SELECT HoleID, From_m, To_m, Easting AS X, Northing AS Y, Elevation AS Z, {_r('round_even(dip, 3)', 9, 'Dip')}, {_r(f'round_even({v.dip_azimuth("strike")}, 3)', 9, 'DipAzimuth')},
{_r(f'round_even(CASE WHEN (tl1 - tl2) / tl1 >= 0.05 THEN {pitch} ELSE 0 END, 3)', 9, 'Pitch')}, {_r('round_even(greatest(0, least(1, (tl2 - tl3) / tl1)), 4)', 9, 'Planarity')}, {_r('round_even(greatest(0, least(1, (tl1 - tl2) / tl1)), 4)', 9, 'Linearity')},
local_n AS LocalN, local_holes AS LocalHoles, NULL::DOUBLE AS VsReferenceDeg, 'shape_pca' AS Estimator FROM f JOIN active ON src_index = i""",
        "neighbor_agreement": f"WITH {_weights()}, {SHAPE}, p AS ({_poles('shape', V3)}) SELECT e.i AS src_index, {_r(f'median({_ANGLE})', 4, 'agreement_deg')} FROM e JOIN p a ON e.i = a.i JOIN p b ON e.j = b.i GROUP BY e.i",
        "coherence_null": f"WITH {_weights()}, {SHAPE}, q AS ({_poles('shape', V3)}), dealt AS (SELECT row_number() OVER (ORDER BY md5('0/' || i), i) AS k, px, py, pz FROM q), p AS (SELECT i, px, py, pz FROM (SELECT i, row_number() OVER (ORDER BY md5(i::VARCHAR), i) AS k FROM q) AS places JOIN dealt USING (k)), one AS (SELECT median({_ANGLE}) AS agreement_deg FROM e JOIN p a ON e.i = a.i JOIN p b ON e.j = b.i GROUP BY e.i) SELECT {_r('median(agreement_deg)', 3, 'null_deg')} FROM one",
        "split_half": f"WITH {_weights()}, halves AS (SELECT * FROM {_eigen(halves)} AS f), p AS (SELECT i, half, v3x AS px, v3y AS py, v3z AS pz FROM halves) SELECT a.i AS src_index, {_r(_ANGLE, 3, 'angle_deg')} FROM p a JOIN p b ON a.i = b.i AND a.half = 0 AND b.half = 1",
        "split_half_random": f"WITH {_weights()}, halves AS (SELECT * FROM {_eigen(halves_random)} AS f), p AS (SELECT i, half, v3x AS px, v3y AS py, v3z AS pz FROM halves) SELECT a.i AS src_index, {_r(_ANGLE, 3, 'angle_deg')} FROM p a JOIN p b ON a.i = b.i AND a.half = 0 AND b.half = 1",
        "smooth_scores_1": _smooth(1, 0.5),
        "smooth_scores_3": _smooth(3, 0.7),
        "smooth_tensor_2": _smooth_tensors(2),
        "contacts_extract": f"WITH {CONTACTS} SELECT HoleID, code, boundary, depth_m, {', '.join(_r(c, 4) for c in 'xyz')} FROM contacts",
        "contact_planes": f"WITH {PLANES_SQL} SELECT code, boundary, n_holes, {_r(strike, 3, 'strike_deg')}, {_r(dip, 3, 'dip_deg')}, {_r('sqrt(greatest(tl3, 0))', 4, 'rms_resid_m')}, {_r('1 - tl3 / tl1', 5, 'planarity')}, {_r('collar_aspect', 5)}, {_r('extent_m', 3)}, collar_aspect >= 0.15 AS usable, {', '.join(_r(c, 3) for c in ('cx', 'cy', 'cz'))} FROM planes",
        "contacts_compare": f"WITH {_comparison()} SELECT method, code, boundary, n_holes, n_nodes, {_r('median_err_deg', 3)}, {_r('p25_err_deg', 3)} FROM compared",
        "contacts_pivot": f"WITH {_comparison()} SELECT code, boundary, {', '.join(_r(f'avg(median_err_deg) FILTER (WHERE method = {m!r})', 3, m) for m in ('shape_pca', 'lsq_gradient', 'drill_pattern'))} FROM compared GROUP BY code, boundary",
        "contacts_weighted": f"WITH {_comparison()} SELECT method, {_r('sum(n_nodes * median_err_deg) / sum(n_nodes)', 3, 'weighted_err_deg')} FROM compared GROUP BY method",
        "orientation_tensor_by_label": f"WITH {UNITS} SELECT label, count(*) AS n, {', '.join(_r(f'avg(u{k[0]} * u{k[1]})', 8, f't{k}') for k in SIX)} FROM u GROUP BY label",
        "woodcock_by_label": f"WITH {UNITS}, t AS (SELECT label, count(*) AS n, {', '.join(f'avg(u{k[0]} * u{k[1]}) AS t{k}' for k in SIX)} FROM u GROUP BY label), s AS (SELECT label, n, {S1} AS S1, {S2} AS S2, {S3} AS S3 FROM {in_sql('t', eigenvalue_steps('t'))} AS e) SELECT label, n, {_r('S1', 7)}, {_r('S2', 7)}, {_r('S3', 7)}, CASE WHEN S1 > S2 AND S2 > S3 THEN round(ln(S1 / S2) / ln(S2 / S3), 5) + 0.0 ELSE 'inf'::DOUBLE END AS K, {_r('ln(S1 / S3)', 6, 'C')} FROM s",
        "trend_plunge": _angles(trend=v.trend(U), plunge=v.plunge(U)),
        "strike_dip": _angles(strike=v.strike(U), dip=v.dip(U), dip_azimuth=v.dip_azimuth(v.strike(U))),
        "strike_dip_roundtrip": _angles(nx=nx, ny=ny, nz=nz),
        "angular_difference": _angles(to_up=v.angle(U, ("0e0", "0e0", "1e0")), to_axis=v.angle(U, ("1e0", "2e0", "-1e0"))),
        "equal_area_xy": _angles(x=ex, y=ey),
        # What goes in has to come out.
        "pitch_cases": f"WITH {VECTORS}, given AS (SELECT vec_id, 5 + floor(abs(vx) * 1000) % 80 AS dip, floor(abs(vy) * 1000) % 360 AS dip_azimuth, 3 + floor(abs(vz) * 1000) % 175 AS rake FROM vecs) SELECT vec_id, dip::DOUBLE AS dip, dip_azimuth::DOUBLE AS dip_azimuth, rake::DOUBLE AS rake, dip::DOUBLE AS dip_back, dip_azimuth::DOUBLE AS dip_azimuth_back, rake::DOUBLE AS pitch_back FROM given",
        "synthetic_tables": f"WITH {fold} SELECT src_index, {_r('away', 5, 'shell_distance')}, {_r('grade', 6, 'shell_grade')}, {', '.join(_r(f'n{c}', 7, f'true_pole_{c}') for c in 'xyz')} FROM fold",
        "synthetic_recovery": f"WITH points AS ({fx.POINTS}), {fold}, logs AS (SELECT points.*, ln(1 + greatest(grade, 0)) AS v FROM points JOIN fold USING (src_index))," + _weights().split("AS v FROM points),", 1)[1] + f", {SHAPE} SELECT i AS src_index, {_r(v.angle(V3, ('nx', 'ny', 'nz')), 3, 'error_deg')} FROM shape JOIN fold ON src_index = i",
        "lsq_conditioned_field": f"WITH {_weights()}, {_lsq()} SELECT i AS src_index, {_r('sampling_conditioning', 6)}, {_r('gradient_magnitude', 6)} FROM lsq WHERE sampling_conditioning >= 0.15",
        "station_dedupe": f"""WITH collars AS ({fx.COLLARS}), logged AS ({fx.SURVEYS}), given AS (SELECT HoleID, Depth_m, Dip, Azimuth FROM logged UNION ALL SELECT HoleID, Depth_m, Dip - 1.5e0, Azimuth FROM logged WHERE (Depth_m / 30)::INT % 2 = 0),
one AS (SELECT HoleID, Depth_m, min(Dip) AS Dip, min(Azimuth) AS Azimuth FROM given GROUP BY ALL UNION ALL SELECT HoleID, 0e0, Dip, Azimuth FROM collars WHERE HoleID NOT IN (SELECT HoleID FROM given WHERE Depth_m <= 0))
SELECT HoleID, Depth_m, {', '.join(_r(e, 6, f'd{c}') for c, e in zip('xyz', v.direction('Dip', 'Azimuth'), strict=True))} FROM one""",
        "filter_prospect": f"SELECT src_index, HoleID FROM ({fx.POINTS}) AS p JOIN ({fx.COLLARS}) AS c USING (HoleID) WHERE Prospect = 'Section 1'",
        "collar_metadata": f"SELECT src_index, Property, Prospect, Length_m AS hole_length_m FROM ({fx.POINTS}) AS p JOIN ({fx.COLLARS}) AS c USING (HoleID)",
        "surrogate_ids": f"SELECT HoleID, From_m, (row_number() OVER (ORDER BY HoleID, From_m, To_m) - 1)::BIGINT AS src_index FROM ({fx.POINTS}) AS p",
        "csv_round_trip": f"SELECT HoleID, From_m, To_m, 0.5e0 * (From_m + To_m) AS mid_m, {_r('assay', 4)}, {', '.join(_r(c, 3) for c in ('Easting', 'Northing', 'Elevation'))} FROM ({fx.POINTS}) AS p",
        "pole_density": f"""WITH {_weights()}, {SHAPE}, xy AS (SELECT {x} AS x, {y} AS y FROM shape), cells AS (SELECT (cx + 0.5) * 2 / 50e0 - 1 AS px, (cy + 0.5) * 2 / 50e0 - 1 AS py, count(*) AS n FROM (SELECT floor((x + 1) * 50 / 2) AS cx, floor((y + 1) * 50 / 2) AS cy FROM xy) AS c GROUP BY cx, cy),
grid AS (SELECT a * 0.1e0 - 1 AS gx, b * 0.1e0 - 1 AS gy FROM generate_series(0, 20) AS s(a), generate_series(0, 20) AS t(b) WHERE (a * 0.1e0 - 1) * (a * 0.1e0 - 1) + (b * 0.1e0 - 1) * (b * 0.1e0 - 1) <= 1)
SELECT {_r('gx', 6)}, {_r('gy', 6)}, {_r('sum(n * exp(-((gx - px) * (gx - px) + (gy - py) * (gy - py)) / (2 * 0.09e0 * 0.09e0))) / sum(n)', 6, 'density')} FROM grid, cells GROUP BY gx, gy""",
        # Six holes, three in a half: samples of one hole lie on a line, whose planes hang on rounding.
        "method_summary": _method_summary().replace("local_holes >= 3", "local_holes >= 6").replace("local_holes >= 1", "local_holes >= 3"),
        "parameter_sweep": _sweep(),
        "geometry_floats": f"""WITH {_weights()}{UNGRADED[len(_edges()) :].replace(chr(10) + 'w AS', chr(10) + 'wu AS')}, {SHAPE}, shape_u AS (SELECT * FROM {_eigen('(SELECT * FROM ' + _covariance(table='wu') + ' AS c WHERE local_n >= 10 AND local_holes >= 3)')} AS f),
vs AS (SELECT a.i, {_ANGLE} AS deg FROM ({_poles('shape', V3)}) a JOIN ({_poles('shape_u', V3)}) b ON a.i = b.i), holes AS (SELECT HoleID, row_number() OVER (ORDER BY min(i)) - 1 AS code FROM shape JOIN active ON src_index = i GROUP BY HoleID),
box AS (SELECT min(Easting) AS x0, min(Northing) AS y0, min(Elevation) AS z0 FROM active)
SELECT i AS src_index, {', '.join(_r(f'({e})::FLOAT::DOUBLE', n, k) for k, n, e in (('fx', 2, 'Easting - x0'), ('fy', 2, 'Northing - y0'), ('fz', 2, 'Elevation - z0'), ('dip', 2, dip), ('dip_azimuth', 2, v.dip_azimuth(strike)), ('trend', 2, v.trend(V3)), ('plunge', 2, v.plunge(V3)), ('planarity', 3, 'greatest(0, least(1, (tl2 - tl3) / tl1))'), ('score', 3, 'min_score'), ('vs_reference', 3, 'vs.deg')))}, code::INT AS hole_index
FROM shape JOIN active ON src_index = i JOIN holes USING (HoleID) LEFT JOIN vs USING (i), box""",
        "trace_offsets": f"WITH {SCORED}, box AS (SELECT min(Easting) AS x0, min(Elevation) AS z0 FROM active), h AS (SELECT HoleID, count(*) AS n, arg_min(Easting, From_m) AS x, arg_max(Elevation, From_m) AS z FROM points GROUP BY HoleID) SELECT HoleID, (sum(n) OVER (ORDER BY HoleID) - n)::BIGINT AS start, n, (x - x0)::FLOAT::DOUBLE AS first_x, (z - z0)::FLOAT::DOUBLE AS last_z FROM h, box",
        "thinned_field": f"WITH {_weights()}, {SHAPE}, f AS (SELECT i, min_score, {dip} AS plane_dip_deg, row_number() OVER (ORDER BY i) - 1 AS k, row_number() OVER (ORDER BY min_score) - 1 AS r, count(*) OVER () AS n FROM shape JOIN active ON src_index = i), ends AS (SELECT max(CASE WHEN r = least(n - 1, floor(0.02e0 * n)) THEN min_score END) AS low, max(CASE WHEN r = least(n - 1, floor(0.98e0 * n)) THEN min_score END) AS high FROM f) SELECT i AS src_index, {_r('plane_dip_deg', 4)}, {_r('low', 6)}, {_r('CASE WHEN high > low THEN high ELSE low + 1 END', 6, 'high')} FROM f, ends WHERE k % 5 = 0",
        "contact_head": f"WITH {PLANES_SQL} SELECT code, boundary, n_holes, {_r(strike, 3, 'strike_deg')}, {_r(dip, 3, 'dip_deg')} FROM planes WHERE collar_aspect >= 0.15 ORDER BY n_holes DESC, code, boundary LIMIT 4",
        "truth_error": f"WITH {_weights()}, {SHAPE}, truth AS ({fx.TRUTH}) SELECT src_index, {_r(v.angle(V3, ('true_pole_x', 'true_pole_y', 'true_pole_z')), 4, 'error_deg')} FROM shape JOIN truth ON i = src_index",
        "prospects": f"SELECT Prospect, count(*) AS n FROM ({fx.POINTS}) AS p JOIN ({fx.COLLARS}) AS c USING (HoleID) GROUP BY Prospect HAVING count(*) >= 300",
    }
    return out
