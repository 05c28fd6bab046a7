"""Symmetric 3 x 3 matrices in closed form: DataFrame steps that keep intermediate values as columns.

A matrix is six columns prefix + xx, yy, zz, xy, yz, xz.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIX = ("xx", "yy", "zz", "xy", "yz", "xz")


def eigenvalue_steps(p: str = "t") -> list[dict[str, str]]:
    """Columns to add, step by step, up to {p}l1 >= {p}l2 >= {p}l3, by the trigonometric solution."""
    t = {k: f"{p}{k}" for k in SIX}
    return [
        {f"{p}q": f"({t['xx']} + {t['yy']} + {t['zz']}) / 3e0"},
        {f"{p}p": f"sqrt((power({t['xx']} - {p}q, 2) + power({t['yy']} - {p}q, 2) + power({t['zz']} - {p}q, 2) + 2e0 * ({t['xy']} * {t['xy']} + {t['yz']} * {t['yz']} + {t['xz']} * {t['xz']})) / 6e0)"},
        {f"{p}d": f"CASE WHEN {p}p > 0 THEN (({t['xx']} - {p}q) * (({t['yy']} - {p}q) * ({t['zz']} - {p}q) - {t['yz']} * {t['yz']}) - {t['xy']} * ({t['xy']} * ({t['zz']} - {p}q) - {t['yz']} * {t['xz']}) + {t['xz']} * ({t['xy']} * {t['yz']} - ({t['yy']} - {p}q) * {t['xz']})) / (2e0 * {p}p * {p}p * {p}p) ELSE 0e0 END"},
        {f"{p}phi": f"acos(greatest(-1e0, least(1e0, {p}d))) / 3e0"},
        {f"{p}l1": f"{p}q + 2e0 * {p}p * cos({p}phi)", f"{p}l3": f"{p}q + 2e0 * {p}p * cos({p}phi + 2e0 * pi() / 3e0)"},
        {f"{p}l2": f"3e0 * {p}q - {p}l1 - {p}l3"},
    ]


def eigenvector_steps(p: str, value: str, out: str) -> list[dict[str, str]]:
    """Columns {out}x, {out}y, {out}z: the unit vector of an eigenvalue, upwards, as the longest cross product of two rows."""
    t = {k: f"{p}{k}" for k in SIX}
    rows = ((f"({t['xx']} - {value})", t["xy"], t["xz"]), (t["xy"], f"({t['yy']} - {value})", t["yz"]), (t["xz"], t["yz"], f"({t['zz']} - {value})"))
    cross = lambda a, b: (f"{a[1]} * {b[2]} - {a[2]} * {b[1]}", f"{a[2]} * {b[0]} - {a[0]} * {b[2]}", f"{a[0]} * {b[1]} - {a[1]} * {b[0]}")
    steps = [{f"_{out}{k}{c}": e for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))) for c, e in zip("xyz", cross(rows[i], rows[j]), strict=True)}]
    steps.append({f"_{out}n{k}": f"_{out}{k}x * _{out}{k}x + _{out}{k}y * _{out}{k}y + _{out}{k}z * _{out}{k}z" for k in range(3)})
    best = lambda c: f"CASE WHEN _{out}n0 >= _{out}n1 AND _{out}n0 >= _{out}n2 THEN _{out}0{c} WHEN _{out}n1 >= _{out}n2 THEN _{out}1{c} ELSE _{out}2{c} END"
    size = f"greatest(_{out}n0, _{out}n1, _{out}n2)"
    steps.append({f"_{out}{c}": f"({best(c)}) / CASE WHEN {size} > 0 THEN sqrt({size}) ELSE 1e0 END" for c in "xyz"} | {f"_{out}ok": f"{size} > 0"})
    # Without any cross product all directions are alike; up is taken.
    up = f"CASE WHEN _{out}z < 0 OR _{out}z = 0 AND (_{out}y < 0 OR _{out}y = 0 AND _{out}x < 0) THEN -1e0 ELSE 1e0 END"
    steps.append({f"{out}x": f"CASE WHEN _{out}ok THEN {up} * _{out}x ELSE 0e0 END", f"{out}y": f"CASE WHEN _{out}ok THEN {up} * _{out}y ELSE 0e0 END", f"{out}z": f"CASE WHEN _{out}ok THEN {up} * _{out}z ELSE 1e0 END"})
    return steps


def solve_steps(a: str, b: str, ridge: float, out: str) -> list[dict[str, str]]:
    """Columns {out}x, {out}y, {out}z: the solution of (A + ridge * trace(A) / 3 * I) g = b by Cramer's rule; b: prefix of x, y, z."""
    t = {k: f"{a}{k}" for k in SIX}
    scale = f"({t['xx']} + {t['yy']} + {t['zz']}) / 3e0"
    steps = [{f"_{out}r": f"{ridge!r} * CASE WHEN {scale} > 0 THEN {scale} ELSE 1e0 END"}]
    xx, yy, zz = (f"({t[k]} + _{out}r)" for k in ("xx", "yy", "zz"))
    xy, yz, xz = t["xy"], t["yz"], t["xz"]
    steps.append({f"_{out}cxx": f"{yy} * {zz} - {yz} * {yz}", f"_{out}cxy": f"{xz} * {yz} - {xy} * {zz}", f"_{out}cxz": f"{xy} * {yz} - {xz} * {yy}", f"_{out}cyy": f"{xx} * {zz} - {xz} * {xz}", f"_{out}cyz": f"{xy} * {xz} - {xx} * {yz}", f"_{out}czz": f"{xx} * {yy} - {xy} * {xy}"})
    steps.append({f"_{out}det": f"{xx} * _{out}cxx + {xy} * _{out}cxy + {xz} * _{out}cxz"})
    row = lambda i, j, k: f"CASE WHEN _{out}det = 0 THEN 0e0 ELSE (_{out}{i} * {b}x + _{out}{j} * {b}y + _{out}{k} * {b}z) / _{out}det END"
    steps.append({f"{out}x": row("cxx", "cxy", "cxz"), f"{out}y": row("cxy", "cyy", "cyz"), f"{out}z": row("cxz", "cyz", "czz")})
    return steps


def add(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    """df with the columns of each step, whose expressions may name those of earlier ones."""
    for step in steps:
        df = df.withColumns({k: F.expr(e).cast("double") if not k.endswith("ok") else F.expr(e) for k, e in step.items()})
    return df


def in_sql(source: str, steps: list[dict[str, str]]) -> str:
    """The same as nested selects around a table or query."""
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in step.items())} FROM {source})"
    return source


def eigen(df: DataFrame, p: str = "t", major: str | None = "v1", minor: str | None = "v3") -> DataFrame:
    """Adds {p}l1 >= {p}l2 >= {p}l3 and unit vectors of the largest and the smallest."""
    df = add(df, eigenvalue_steps(p))
    for out, value in ((major, f"{p}l1"), (minor, f"{p}l3")):
        if out:
            df = add(df, eigenvector_steps(p, value, out))
    return df.drop(*(c for c in df.columns if c.startswith("_v")), f"{p}q", f"{p}p", f"{p}d", f"{p}phi")


def eigen_lapack(df: DataFrame, p: str = "t", major: str = "v1", minor: str = "v3") -> DataFrame:
    """The same by numpy in Arrow batches, for nearly equal eigenvalues."""
    result = "struct<" + ",".join(f"{k}:double" for k in ("l1", "l2", "l3", *(f"{v}{c}" for v in "ab" for c in "xyz"))) + ">"

    @F.pandas_udf(result)
    def decomposed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for xx, yy, zz, xy, yz, xz in batches:
            t = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
            values, vectors = np.linalg.eigh(t)
            sides = []
            for x, y, z in (vectors[:, :, k].T for k in (2, 0)):
                down = (z < 0) | (z == 0) & ((y < 0) | (y == 0) & (x < 0))
                sides.append(np.where(down, -1.0, 1.0)[:, None] * np.stack([x, y, z], 1))
            yield pd.DataFrame(np.column_stack([values[:, ::-1], *sides]), columns=["l1", "l2", "l3", *(f"{v}{c}" for v in "ab" for c in "xyz")])

    e = df.withColumn("_e", decomposed(*(f"{p}{k}" for k in SIX)))
    new: dict[str, Column] = {f"{p}{k}": F.col(f"_e.{k}") for k in ("l1", "l2", "l3")}
    new |= {f"{out}{c}": F.col(f"_e.{v}{c}") for v, out in (("a", major), ("b", minor)) for c in "xyz"}
    return e.withColumns(new).drop("_e")
