"""A field that grows batch by batch equals one made at once."""

import pytest
from pyspark.sql import functions as F

from planemark.operators.estimators import orientations
from planemark.plans import fixtures as fx
from planemark.sources import tables
from planemark.streaming.ingest import point_stream
from planemark.streaming.live import LiveField, calibrate, placed

COLUMNS = ["BHID", "From", "To", "X", "Y", "Z", "assay"]


@pytest.fixture(scope="module")
def points(spark, sf):
    return tables.intervals(fx.points(spark, sf)).drop("src_index")


def close(a, b):
    a, b = ({r.src_index: r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys() and a
    assert all(a[k].local_n == b[k].local_n and a[k].HoleID == b[k].HoleID and all(abs(a[k][f"pole_vec_{c}"] - b[k][f"pole_vec_{c}"]) < 1e-7 for c in "xyz") for k in a)


@pytest.mark.parametrize("name", ["shape_pca", "lsq_gradient"])
def test_batches_equal_one_read(spark, points, tmp_path, name):
    cfg = fx.config(min_neighbors=5, min_holes=3, radius_m=90.0, estimator=name)
    cal = calibrate(points, cfg)
    whole = orientations(placed(points, cal), cfg, floor=cal.floor)
    text = points.select(F.col("HoleID").alias("BHID"), F.col("From_m").alias("From"), F.col("To_m").alias("To"), F.col("Easting").alias("X"), F.col("Northing").alias("Y"), F.col("Elevation").alias("Z"), "assay").toPandas()
    (tmp_path / "in").mkdir()
    # Holes 8 to 14 stand apart in the second file, which also brings some samples again.
    late = text.BHID.isin([f"H{k}" for k in range(8, 15)])
    text[~late].to_csv(tmp_path / "in/a.csv", index=False)
    (text[late | (text.index % 50 == 0)]).to_csv(tmp_path / "in/b.csv", index=False)
    live = LiveField(spark, str(tmp_path / "live"), cal, cfg)
    stream = point_stream(spark, str(tmp_path / "in"), COLUMNS, cfg, files=1)
    live.follow(stream, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "live/samples")).select("batch").distinct().count() == 2
    close(live.field(), whole)
    # A batch that comes again after a failure.
    again = tables.load_points(spark, str(tmp_path / "in/b.csv"), cfg)
    live.add(again, 1)
    close(live.field(), whole)
    live.add(again.limit(0), 2)
    close(live.field(), whole)


def test_a_batch_leaves_far_tiles_alone(spark, points, tmp_path):
    cfg = fx.config(min_neighbors=5, min_holes=1, radius_m=60.0)
    cal = calibrate(points, cfg)
    live = LiveField(spark, str(tmp_path / "live"), cal, cfg)
    live.add(points, 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "live/field").glob("tile=*/*.parquet")}
    live.add(points.where("HoleID = 'H0'").withColumn("assay", F.lit(1e9)).withColumn("From_m", F.col("From_m") + 0.01).limit(3), 1)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "live/field").glob("tile=*/*.parquet")}
    kept = {p for p in before if after.get(p) == before[p]}
    assert kept and len(kept) < len(before)
