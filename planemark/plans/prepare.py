"""From tables to scored and active samples."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.desurvey import all_depths, hole_traces, paths, placed, unique_collars, with_src_index
from ..operators.estimators import orientations
from ..operators.score import scored
from ..sources.store import written
from ..sources.tables import load_points, load_tables


@dataclass
class Prepared:
    """scored: all samples with places, score and rank; active: those that take part, written once; paths: hole paths."""

    scored: DataFrame
    active: DataFrame
    paths: DataFrame

    def orientations(self, cfg: dict[str, Any], name: str | None = None) -> DataFrame:
        return orientations(self.active, cfg, name)


def prepare_points(points: DataFrame, cfg: dict[str, Any]) -> Prepared:
    """points: as from load_points, with coordinates of the samples' middles."""
    placed = with_src_index(points).withColumns({"mid_x": F.col("Easting"), "mid_y": F.col("Northing"), "mid_z": F.col("Elevation")})
    all_ = scored(placed, cfg["score_columns"], cfg["log_transform_score"], cfg["active_score_quantile"])
    return Prepared(all_, written(all_.where("is_active"), "active"), hole_traces(placed))


#: What paths and placed() take of collars and surveys.
COLLAR = ("HoleID", "Easting", "Northing", "Elevation", "Length_m", "Dip", "Azimuth", "Property", "Prospect", "HoleType")
SURVEY = ("HoleID", "Depth_m", "Dip", "Azimuth")


def prepare_tables(samples: DataFrame, collars: DataFrame, surveys: DataFrame, cfg: dict[str, Any]) -> Prepared:
    """The three tables, as from load_tables. Each is written once, and of the samples only the active ones are placed for `active`; paths
    go through the depths of all."""
    collars = unique_collars(written(collars.select(*(c for c in COLLAR if c in collars.columns)), "collars"))
    samples = written(with_src_index(samples).join(collars.select("HoleID"), "HoleID", "left_semi"), "samples")
    path = written(paths(collars, written(surveys.select(*SURVEY), "surveys"), all_depths(samples)), "paths")
    score = lambda df: scored(df, cfg["score_columns"], cfg["log_transform_score"], cfg["active_score_quantile"])
    if not set(cfg["score_columns"]) <= set(samples.columns):
        # What is not among the samples' columns may come with their places.
        all_ = score(placed(samples, collars, path))
        return Prepared(all_, written(all_.where("is_active"), "active"), path)
    added = ("min_score", "score_rank", "is_active")

    def place(df: DataFrame) -> DataFrame:
        out = placed(df, collars, path)
        return out.select(*(c for c in out.columns if c not in added), *added)

    ranked = score(samples)
    return Prepared(place(ranked), written(place(ranked.where("is_active")), "active"), path)


def from_points(spark: SparkSession, source: str | DataFrame, cfg: dict[str, Any]) -> Prepared:
    return prepare_points(load_points(spark, source, cfg), cfg)


def from_tables(spark: SparkSession, samples: str | DataFrame, collars: str | DataFrame, surveys: str | DataFrame, cfg: dict[str, Any]) -> Prepared:
    return prepare_tables(*load_tables(spark, samples, collars, surveys, cfg), cfg)
