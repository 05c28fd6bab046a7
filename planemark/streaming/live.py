"""A field that grows with a stream of new samples: each batch rewrites the tiles of space that its samples can change, no others.

Scores and the active samples' limit hang on all samples, so they are fixed beforehand by a table of earlier ones (`calibrate`); then a
sample's planes hang on what lies within the radius alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.estimators import orientations
from ..operators.ordering import quantiles
from ..operators.score import prepared, usable_columns
from ..sources.store import discard, written

#: Sides of a tile in radii.
SIDE = 4


@dataclass(frozen=True)
class Calibration:
    """Means and deviations of the score's columns, the least active score, and the one that weights count from."""

    columns: dict[str, tuple[float, float]]
    log: bool
    least_active: float
    floor: float

    def score(self) -> Column:
        parts = [F.coalesce((prepared(c, self.log) - m) / s, F.lit(0.0)) for c, (m, s) in self.columns.items()]
        return sum(parts[1:], parts[0]) / len(parts)


def calibrate(points: DataFrame, cfg: dict[str, Any]) -> Calibration:
    """From a table of points as from load_points: the scores' columns, and the score at the quantile of active samples."""
    columns = usable_columns(points, cfg["score_columns"], cfg["log_transform_score"])
    first = Calibration(columns, cfg["log_transform_score"], 0.0, 0.0)
    scores = written(points.select(first.score().alias("s")), "scores")
    limit = quantiles(scores, "s", {"q": cfg["active_score_quantile"]}).first()["q"]
    floor = scores.where(F.col("s") >= limit).agg(F.min("s")).first()[0]
    discard(scores)
    return Calibration(columns, cfg["log_transform_score"], limit, floor)


def _tile(place: dict[str, Column], side: float) -> Column:
    return F.concat_ws("_", *(F.floor(place[c] / side).cast("long").cast("string") for c in "xyz"))


def placed(points: DataFrame, cal: Calibration) -> DataFrame:
    """Active samples of a batch with what the field needs. Null holes, depths or places are left out."""
    rows = points.dropna(subset=["HoleID", "From_m", "To_m", "Easting", "Northing", "Elevation"]).withColumn("min_score", cal.score()).where(F.col("min_score") >= cal.least_active)
    at = {"mid_x": F.col("Easting"), "mid_y": F.col("Northing"), "mid_z": F.col("Elevation"), "src_index": F.xxhash64("HoleID", "From_m", "To_m")}
    return rows.withColumns(at).select("src_index", "HoleID", "From_m", "To_m", "mid_m", "interval_m", "mid_x", "mid_y", "mid_z", "min_score")


class LiveField:
    """Tables under `folder`: samples by batch, and the field by tile. Both can be read at any time."""

    def __init__(self, spark: SparkSession, folder: str, cal: Calibration, cfg: dict[str, Any]):
        self.spark, self.folder, self.cal, self.cfg = spark, folder.rstrip("/"), cal, cfg
        self.side = SIDE * cfg["radius_m"]

    def samples(self) -> DataFrame:
        """All active samples so far; of those with one hole and depths the one of the first batch, then of the smallest values."""
        rows = self.spark.read.parquet(f"{self.folder}/samples")
        given = [c for c in rows.columns if c not in ("src_index", "batch")]
        first = rows.groupBy("src_index").agg(F.min(F.struct("batch", *given)).alias("first"))
        return first.select("src_index", *(f"first.{c}" for c in given))

    def field(self) -> DataFrame:
        """All planes so far; there is no table before the first ones."""
        return self.spark.read.parquet(f"{self.folder}/field").drop("tile")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Takes a batch of points in. The same batch again, whole or after half of this, gives the same tables: its samples are written over
        themselves, and tiles are made from all samples. Samples are only added, so a tile with planes keeps some."""
        spark, r = self.spark, self.cfg["radius_m"]
        placed(batch, self.cal).write.mode("overwrite").parquet(f"{self.folder}/samples/batch={batch_id}")
        new = spark.read.parquet(f"{self.folder}/samples/batch={batch_id}")
        if new.isEmpty():
            return
        place = {c: F.col(f"mid_{c}") for c in "xyz"}
        # A sample changes what lies within the radius: the tiles of the corners of a box around it, as tiles are wider than the box.
        corners = F.array_distinct(F.array(*(_tile({c: place[c] + k * r for c, k in zip("xyz", (a, b, d), strict=True)}, self.side) for a in (-1, 1) for b in (-1, 1) for d in (-1, 1))))
        touched = written(new.select(F.explode(corners).alias("tile")).distinct(), "tiles")
        # What is made anew needs the samples within the radius of its tile.
        every = self.samples().withColumns({"tile": _tile(place, self.side), "_near": corners})
        needed = every.withColumn("_t", F.explode("_near")).join(touched.select(F.col("tile").alias("_t")), "_t", "left_semi").drop("_t", "_near").distinct()
        around = written(needed, "around")
        made = orientations(around.drop("tile"), self.cfg, floor=self.cal.floor).withColumn("tile", _tile(place, self.side))
        made = made.join(touched, "tile", "left_semi")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(f"{self.folder}/field")
        discard(touched, around)

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Adds a stream of points, as from point_stream, batch by batch; once: what is there now, then stop."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if once else writer.start()
