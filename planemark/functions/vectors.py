"""Angles and vectors, as SQL text over names of columns or other expressions. Axes are east, north, up; angles are degrees.

Text, so that one formula serves columns in Spark and can be read in any engine; `col` makes a column of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[str, str, str]


def col(text: str) -> Column:
    return F.expr(text)


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True)) + ")"


def unit(v: Vec) -> Vec:
    """v over its length; a zero vector stays."""
    size = f"sqrt({dot(v, v)})"
    return tuple(f"(({x}) / CASE WHEN {size} = 0 THEN 1e0 ELSE {size} END)" for x in v)  # type: ignore[return-value]


def bearing(x: str) -> str:
    """x modulo 360, from 0 up."""
    return f"(({x}) - 360e0 * floor(({x}) / 360e0))"


def direction(dip: str, azimuth: str) -> Vec:
    """The unit vector of a dip (negative downwards) and an azimuth."""
    d, a = f"radians({dip})", f"radians({azimuth})"
    return (f"(cos({d}) * sin({a}))", f"(cos({d}) * cos({a}))", f"sin({d})")


def trend(v: Vec) -> str:
    """Bearing of the downward end of an axis."""
    s = f"(CASE WHEN ({v[2]}) > 0 THEN -1e0 ELSE 1e0 END)"
    return bearing(f"degrees(atan2({s} * ({v[0]}), {s} * ({v[1]})))")


def plunge(v: Vec) -> str:
    return f"degrees(asin(least(1e0, abs({v[2]}))))"


def strike(n: Vec) -> str:
    """Strike of the plane with normal n; the plane dips to its right."""
    s = f"(CASE WHEN ({n[2]}) < 0 THEN -1e0 ELSE 1e0 END)"
    return bearing(f"degrees(atan2({s} * ({n[0]}), {s} * ({n[1]}))) - 90e0")


def dip(n: Vec) -> str:
    return f"degrees(acos(least(1e0, abs({n[2]}))))"


def normal(strike_: str, dip_: str) -> Vec:
    """The upward normal of a plane."""
    s, d = f"radians(({strike_}) + 90e0)", f"radians({dip_})"
    return (f"(sin({d}) * sin({s}))", f"(sin({d}) * cos({s}))", f"cos({d})")


def angle(a: Vec, b: Vec) -> str:
    """The angle between two axes, 0 to 90."""
    return f"degrees(acos(least(1e0, abs({dot(unit(a), unit(b))}))))"


def dip_azimuth(strike_: str) -> str:
    return bearing(f"({strike_}) + 90e0")


def pitch(strike_: str, dip_: str, line: Vec) -> str:
    """Angle in the plane from its strike to the downward end of a line's projection, 0 to 180; 0 if there is no projection."""
    n, u = normal(strike_, dip_), unit(line)
    along = dot(u, n)
    p: Vec = tuple(f"({x} - {along} * {y})" for x, y in zip(u, n, strict=True))  # type: ignore[assignment]
    size = f"sqrt({dot(p, p)})"
    s: Vec = (f"sin(radians({strike_}))", f"cos(radians({strike_}))", "0e0")
    cosine = f"{dot(s, p)} / CASE WHEN {size} < 1e-9 THEN 1e0 ELSE {size} END * CASE WHEN {p[2]} > 0 THEN -1e0 ELSE 1e0 END"
    return f"CASE WHEN {size} < 1e-9 THEN 0e0 ELSE degrees(acos(greatest(-1e0, least(1e0, {cosine})))) END"


def pitch_steps(strike_: str, dip_: str, line: Vec, out: str) -> list[dict[str, str]]:
    """The same as columns to add, step by step, up to `out`: nested, the text of each part would stand there many times."""
    n = normal(strike_, dip_)
    names = lambda k: tuple(f"{out}_{k}{c}" for c in "xyz")
    u, p, m = names("u"), names("p"), names("n")
    size = f"{out}_size"
    return [
        dict(zip((*u, *m), (*unit(line), *n), strict=True)),
        {f"{out}_along": dot(u, m)},
        {k: f"{x} - {out}_along * {y}" for k, x, y in zip(p, u, m, strict=True)},
        {size: f"sqrt({dot(p, p)})"},
        {f"{out}_cos": f"(sin(radians({strike_})) * {p[0]} + cos(radians({strike_})) * {p[1]}) / CASE WHEN {size} < 1e-9 THEN 1e0 ELSE {size} END * CASE WHEN {p[2]} > 0 THEN -1e0 ELSE 1e0 END"},
        {out: f"CASE WHEN {size} < 1e-9 THEN 0e0 ELSE degrees(acos(greatest(-1e0, least(1e0, {out}_cos)))) END"},
    ]


def equal_area(trend_: str, plunge_: str) -> tuple[str, str]:
    """Place of a downward axis on the equal-area disc of radius 1."""
    r = f"(sqrt(2e0) * sin((radians(90e0) - radians({plunge_})) / 2e0))"
    return f"({r} * sin(radians({trend_})))", f"({r} * cos(radians({trend_})))"
