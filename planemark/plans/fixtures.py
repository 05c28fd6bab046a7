"""Drillhole tables over the driver's `events`: its users stand for holes, its rows for samples. Each as SQL that Spark and others read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import settings

#: Row numbers within holes; `div` is written as floor for all dialects.
_NUMBERED = """SELECT event_id, user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS DOUBLE) AS k,
  CAST(user_id % 10 AS DOUBLE) AS h, CAST(floor(user_id / 10e0) AS DOUBLE) AS s, CASE WHEN floor(user_id / 10e0) % 2 = 0 THEN 0.5e0 ELSE -0.5e0 END AS sgn FROM events"""
POINTS = f"""SELECT event_id AS src_index, concat('H', user_id) AS HoleID, 1.5e0 * k AS From_m, 1.5e0 * (k + 1) AS To_m, value AS assay, event_type,
  10000e0 + 40e0 * h + sgn * (k + 0.5e0) * 1.5e0 AS Easting, 10000e0 + 60e0 * s AS Northing, 1000e0 - 0.8660254037844386e0 * (k + 0.5e0) * 1.5e0 AS Elevation
  FROM ({_NUMBERED}) AS numbered"""
COLLARS = f"""SELECT concat('H', user_id) AS HoleID, 10000e0 + 40e0 * h AS Easting, 10000e0 + 60e0 * s AS Northing, 1000e0 AS Elevation, 1.5e0 * count(*) AS Length_m,
  -60e0 AS Dip, CASE WHEN sgn > 0 THEN 90e0 ELSE 270e0 END AS Azimuth, concat('P', user_id % 3) AS Property, concat('Section ', CAST(s AS INT)) AS Prospect
  FROM ({_NUMBERED}) AS numbered GROUP BY user_id, h, s, sgn"""
SURVEYS = f"""SELECT concat('H', user_id) AS HoleID, d AS Depth_m, -60e0 + 0.05e0 * d AS Dip,
  (CASE WHEN sgn > 0 THEN 90e0 ELSE 270e0 END) + 0.08e0 * d + user_id % 5 AS Azimuth
  FROM (SELECT DISTINCT user_id, sgn FROM ({_NUMBERED}) AS numbered) AS holes
  CROSS JOIN (SELECT 0e0 AS d UNION ALL SELECT 30e0 UNION ALL SELECT 60e0 UNION ALL SELECT 90e0) AS depths WHERE d > 0 OR user_id % 7 <> 0"""
#: A plane at every sample that estimates are held against: it turns from section to section.
TRUTH = f"""SELECT src_index, 0.2e0 * cos(0.1e0 * (Northing - 10000e0) / 60e0) AS true_pole_x, 0.6e0 AS true_pole_y, 0.1e0 + 0.05e0 * sin((Easting - 10000e0) / 100e0) AS true_pole_z FROM ({POINTS}) AS points"""
#: As text, with marks for missing values, broken intervals and a flag of low recovery; headers as exports have them.
RAW = f"""SELECT src_index, HoleID AS BHID, CAST(From_m AS VARCHAR(40)) AS "From", CASE WHEN src_index % 31 = 0 THEN CAST(From_m AS VARCHAR(40)) ELSE CAST(To_m AS VARCHAR(40)) END AS "To",
  CASE WHEN src_index % 17 = 0 THEN '-' WHEN src_index % 23 = 0 THEN '<0.01' ELSE CAST(assay AS VARCHAR(40)) END AS assay, CAST(Easting AS VARCHAR(40)) AS X,
  CASE WHEN src_index % 29 = 0 THEN '' ELSE CAST(Northing AS VARCHAR(40)) END AS Y, CAST(Elevation AS VARCHAR(40)) AS Z,
  CASE WHEN src_index % 11 = 0 THEN 'y' WHEN src_index % 13 = 0 THEN NULL ELSE 'N' END AS LowRecovery FROM ({POINTS}) AS points"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace('"', "`").replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, POINTS)


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, RAW)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, TRUTH)


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, COLLARS)


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SURVEYS)


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).selectExpr("HoleID AS holeid", "From_m AS `from`", "To_m AS `to`", "event_type AS Code")


def config(**given) -> dict:  # type: ignore[no-untyped-def]
    """Settings that suit these tables."""
    return settings(**({"score_columns": ["assay"], "active_score_quantile": 0.5, "min_neighbors": 10, "min_holes": 3} | given))
