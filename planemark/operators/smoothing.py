"""Smoothing over the neighbourhood graph, of scores or of matrices. Pairs are given as a function that finds the neighbours' means, as
neighbors.means_over() makes it, or as a table. A table is written once, in buckets of the neighbour; each round is a join with the
values, which meet them there, and a sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matrices import SIX
from ..sources.store import bucketed, discard, written


Means = Callable[[DataFrame, list[str]], DataFrame]


def neighbour_means(values: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(i, _w and _<column>): sum of weights and weighted means of the neighbours' values; values: i and columns. Pairs in buckets of j
    stay where they are: only the values and the sums are exchanged."""
    other = values.select(F.col("i").alias("j"), *(F.col(c).alias(f"_{c}") for c in columns))
    sums = pairs.join(other, "j").groupBy("i").agg(F.sum("w").alias("_w"), *(F.sum(F.col("w") * F.col(f"_{c}")).alias(f"_{c}") for c in columns))
    return sums.select("i", "_w", *((F.col(f"_{c}") / F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)).alias(f"_{c}") for c in columns))


def smooth_scores(scores: DataFrame, pairs: DataFrame | Means, rounds: int = 1, alpha: float = 0.5) -> DataFrame:
    """(i, s) with s moved by alpha towards the mean of its neighbours, some rounds; without neighbours it stays. pairs: i, j, w, or a
    function of values and columns."""
    out = scores.select("i", "s")
    if not callable(pairs) and rounds > 1:
        pairs = bucketed(pairs.select("i", "j", "w"), "j", "pairs")
    for k in range(rounds):
        mean = pairs(out, ["s"]) if callable(pairs) else neighbour_means(out, pairs, ["s"])
        out = out.join(mean, "i", "left").select("i", F.when(F.col("_w") > 0, (1 - alpha) * F.col("s") + alpha * F.col("_s")).otherwise(F.col("s")).alias("s"))
        if k + 1 < rounds:
            out = written(out, "smoothed")
    return out


def smooth_tensors(t: DataFrame, pairs: DataFrame | Means, mu: float = 0.0, rounds: int = 10) -> DataFrame:
    """t (i, txx .. txz, others) with matrices drawn to those of their neighbours by Jacobi rounds; mu of 0 changes nothing.

    pairs: i, j, w, or a function of values and columns; neighbours without a matrix in t do not count.
    """
    if mu <= 0 or rounds <= 0:
        return t
    cols = [f"t{k}" for k in SIX]
    given = written(t.select("i", *cols), "tensors")
    now = given
    here = None if callable(pairs) else bucketed(pairs.join(given.select("i"), "i", "left_semi").join(given.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j", "w"), "j", "pairs")
    for k in range(rounds):
        mean = pairs(now, cols) if callable(pairs) else neighbour_means(now, here, cols)
        w = F.coalesce("_w", F.lit(0.0))
        now = given.join(mean, "i", "left").select("i", *(((F.col(c) + mu * w * F.coalesce(f"_{c}", F.lit(0.0))) / (1 + mu * w)).alias(c) for c in cols))
        last, now = now, written(now, "smoothed")
        if k:
            discard(last)
    return t.drop(*cols).join(now, "i")
