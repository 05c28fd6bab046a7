"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, comp): for each id of links (a, b: longs or other ordered values) the smallest id that it reaches.

    Every round joins each id to the smallest id near it (large and small stars), which halves the paths at least, so the number
    of rounds is about the logarithm of the longest one. Hot ids are pre-aggregated; a star of any size stays a star.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    # As many partitions as the links are worth; a small table in hundreds of them costs more than its work.
    parts = max(4, edges.count() // 200_000)
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(parts), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id")
    labels = stored(labels.coalesce(parts), "labels")
    while True:
        # The label of my label, and the smallest label of my neighbours.
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("upper"))
        jumped = labels.join(up, "comp", "left").select("id", F.coalesce("upper", "comp").alias("comp"))
        near = stored(both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near")).coalesce(parts), "near")
        # A neighbour's label is also a bound for the label's own id: the stars hook onto one another.
        hooked = labels.join(near, labels["id"] == near["a"]).groupBy("comp").agg(F.min("near").alias("near")).select(F.col("comp").alias("id"), F.col("near").alias("comp"))
        every = jumped.unionByName(near.select(F.col("a").alias("id"), F.col("near").alias("comp"))).unionByName(hooked)
        # What changed is counted in the same pass: the label of a row only falls.
        new = every.groupBy("id").agg(F.min("comp").alias("comp"))
        new = stored(new.join(labels.withColumnRenamed("comp", "_old"), "id").select("id", "comp", (F.col("comp") < F.col("_old")).alias("_fell")).coalesce(parts), "labels")
        if new.where("_fell").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")
