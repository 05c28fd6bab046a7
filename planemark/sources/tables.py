"""Drillhole tables: reading, typing, filtering and writing them."""

from __future__ import annotations

import csv
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import quantiles
from .columns import STANDARD, clean, find, mapping, renamed

#: Texts that stand for a missing value.
MISSING = ["-", "", "NA", "N/A", "null", "None", "nan", "NaN", "-nan", "-NaN", "#N/A", "#N/A N/A", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "NULL", "<NA>", "n/a"]
KEYS = ("From_m", "To_m", "Depth_m", "Dip", "Azimuth", "Easting", "Northing", "Elevation", "Length_m")


def name(c: str) -> Column:
    return F.col(f"`{c}`")


def read_table(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A CSV file or folder, all columns as text, or a DataFrame; texts for missing values become nulls."""
    df = source if isinstance(source, DataFrame) else spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(source)
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*(F.when(~name(c).isin(MISSING), name(c)).alias(c) if c in text else name(c) for c in df.columns))


#: Characters of CSV text that an application may hand over; larger tables are files.
MOST_TEXT = 256 << 20


def csv_text(spark: SparkSession, text: str) -> DataFrame:
    """A table from CSV text that an application holds; more than MOST_TEXT is a ValueError. Rows end with their line; quotes, spaces and
    doubled headers are read as in a file. Without a header there is no table."""
    if len(text) > MOST_TEXT:
        raise ValueError(f"text of more than {MOST_TEXT} characters; write it to a file and give its path")
    lines = [x for x in text.lstrip("\ufeff").splitlines() if x.strip()]
    if not lines:
        raise ValueError("no header in the text")
    header = next(csv.reader([lines[0]]))
    rows = spark.createDataFrame([(x,) for x in lines[1:]], "line string")
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    return rows.select(F.from_csv("line", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"'}).alias("r")).select("r.*").toDF(*header)


def number(c: Column) -> Column:
    """c as a double; what is no number, and NaN, is null. Java's suffixes d and f are no part of a number."""
    text = c.cast("string")
    value = text.try_cast("double")
    return F.when(text.rlike("(?i)[0-9.][df]\\s*$") | F.isnan(value), None).otherwise(value)


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    wanted = {c for c in columns if c in df.columns}
    return df.select(*(number(name(c)).alias(c) if c in wanted else name(c) for c in df.columns))


def intervals(df: DataFrame) -> DataFrame:
    """Adds interval_m and mid_m and keeps rows of positive length."""
    out = df.withColumn("interval_m", F.col("To_m") - F.col("From_m")).withColumn("mid_m", 0.5 * (F.col("From_m") + F.col("To_m")))
    return out.where("interval_m > 0")


def without_low_recovery(df: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    flag = cfg["low_recovery_col"]
    if not cfg["exclude_low_recovery"] or flag not in df.columns:
        return df
    return df.where(F.upper(F.coalesce(name(flag).cast("string"), F.lit("N"))) != "Y")


def load_points(spark: SparkSession, source: str | DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """One table of samples with coordinates of their middles: standard names, numbers, positive intervals, no missing coordinate."""
    df = renamed(read_table(spark, source), "points", cfg["columns"]["points"], cfg["auto_detect_columns"])
    df = typed(df, [*KEYS, *cfg["score_columns"]]).withColumn("HoleID", F.col("HoleID").cast("string"))
    return without_low_recovery(intervals(df), cfg).dropna(subset=["HoleID", "Easting", "Northing", "Elevation"])


def load_tables(spark: SparkSession, samples: str | DataFrame, collars: str | DataFrame, surveys: str | DataFrame, cfg: dict[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, collars and surveys with standard names and numbers, for holes that have a collar and a survey."""
    out = []
    for table, source in (("samples", samples), ("collars", collars), ("surveys", surveys)):
        df = renamed(read_table(spark, source), table, cfg["columns"][table], cfg["auto_detect_columns"])
        out.append(typed(df, [*KEYS, *cfg["score_columns"]]).withColumn("HoleID", F.col("HoleID").cast("string")))
    s, c, v = out
    s = without_low_recovery(intervals(s), cfg)
    holes = c.select("HoleID").join(v.select("HoleID"), "HoleID", "left_semi").distinct()
    holes = holes.join(s.select("HoleID"), "HoleID", "left_semi")
    return tuple(t.join(holes, "HoleID", "left_semi") for t in (s, c, v))  # type: ignore[return-value]


def chosen_holes(samples: DataFrame, collars: DataFrame, surveys: DataFrame, cfg: dict[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of the holes that property, prospect and hole filters choose. None chooses all, an empty list none; a filter whose
    column collars lack is ignored."""
    keep = collars
    for setting, column in (("property_filter", "Property"), ("prospect_filter", "Prospect"), ("hole_filter", "HoleID")):
        wanted = cfg[setting]
        if wanted is not None and column in collars.columns:
            wanted = [wanted] if isinstance(wanted, str) else list(wanted)
            keep = keep.where(F.col(column).cast("string").isin([str(x) for x in wanted]) if wanted else F.lit(False))
    ids = keep.select("HoleID").distinct()
    return tuple(t.join(ids, "HoleID", "left_semi") for t in (samples, collars, surveys))  # type: ignore[return-value]


def preview(spark: SparkSession, source: str | DataFrame, table: str, cfg: dict[str, Any], rows: int = 2000) -> dict[str, Any]:
    """How the first rows would be read: the mapping and whether all key columns are there, and columns that look like assays (over half
    numbers, not all alike) with their median and largest value. Key columns of any table are none."""
    df = read_table(spark, source).limit(rows)
    df = df.toDF(*(clean(c) for c in df.columns))
    taken = {find(df.columns, k, n, cfg["auto_detect_columns"]) for k, n in cfg["columns"][table].items()} | {*KEYS, STANDARD["hole"]}
    others = [c for c in df.columns if c not in taken]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(others):
        aggs += [F.count(number(name(c))).alias(f"k{k}"), F.stddev_samp(number(name(c))).alias(f"s{k}"), F.median(number(name(c))).alias(f"m{k}"), F.max(number(name(c))).alias(f"x{k}")]
    row = df.agg(*aggs).first()
    assays = [{"name": c, "median": row[f"m{k}"], "max": row[f"x{k}"]} for k, c in enumerate(others) if row[f"k{k}"] > 0.5 * row["n"] and (row[f"s{k}"] or 0) > 0]
    found = [r.asDict() for r in mapping(spark, df.columns, table, cfg["columns"][table], cfg["auto_detect_columns"]).collect()]
    missing = [r["internal"] for r in found if r["status"] == "MISSING"]
    return {"columns": df.columns, "n_preview_rows": row["n"], "numeric_columns": assays, "mapping": found, "missing": missing, "resolved": not missing}


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, n_null, min, median, max and mean of each of a few columns; one row a column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), number(name(c)).alias("v")) for c in columns))).alias("x")).select("x.*")
    sums = long.groupBy("column").agg(F.count("v").alias("n"), (F.count(F.lit(1)) - F.count("v")).alias("n_null"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    medians = quantiles(long, "v", {"median": 0.5}, ["column"])
    return sums.join(medians, "column").select("column", "n", "n_null", "min", "median", "max", "mean")


def extent(df: DataFrame) -> DataFrame:
    """One row: the box of Easting, Northing, Elevation, the number of holes and of rows."""
    box = [f(c).alias(f"{k}_{c}") for c in ("Easting", "Northing", "Elevation") for k, f in (("min", F.min), ("max", F.max))]
    return df.agg(*box, F.countDistinct("HoleID").alias("n_holes"), F.count(F.lit(1)).alias("n"))


def rim_exposure(df: DataFrame, radius: float) -> DataFrame:
    """One row: how many points lie nearer than radius to the box around all, in plan, and their share."""
    box = df.agg(F.min("Easting"), F.max("Easting"), F.min("Northing"), F.max("Northing")).first()
    if box[0] is None:
        return df.sparkSession.createDataFrame([(0, 0, None)], "n long, n_rim long, share double")
    gap = F.least(F.col("Easting") - box[0], box[1] - F.col("Easting"), F.col("Northing") - box[2], box[3] - F.col("Northing"))
    near = F.sum(F.when(gap < radius, 1).otherwise(0))
    return df.agg(F.count(F.lit(1)).alias("n"), near.alias("n_rim"), (near / F.count(F.lit(1))).alias("share"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def as_csv_text(df: DataFrame) -> str:
    """CSV text for a caller that wants to hold it; for exports of a size that one holds."""
    return df.toPandas().to_csv(index=False)


def ten_digits(df: DataFrame) -> DataFrame:
    """Doubles as texts of ten significant digits, for sample files."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(F.format_string("%.10g", name(c)).alias(c) if isinstance(kinds[c], T.DoubleType) else name(c) for c in df.columns))


def prospects_with(samples: DataFrame, collars: DataFrame, least: int = 1500) -> DataFrame:
    """Prospects with enough samples and their numbers, the largest first."""
    joined = samples.select("HoleID").join(collars.select("HoleID", "Prospect"), "HoleID", "left")
    return joined.groupBy("Prospect").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("Prospect").isNotNull()).orderBy(F.desc("n"), "Prospect")
