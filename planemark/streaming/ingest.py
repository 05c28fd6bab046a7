"""New assay files as a stream: the stateless part of reading point tables. Ranks and the graph need all rows, so what follows reads
the written table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import load_points


def point_stream(spark: SparkSession, folder: str, columns: list[str], cfg: dict[str, Any], files: int | None = None) -> DataFrame:
    """Clean points of CSV files as they arrive in folder; columns: the files' header, all read as text; files: at most so many a batch."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.option("header", True).schema(schema)
    return load_points(spark, (reader.option("maxFilesPerTrigger", files) if files else reader).csv(folder), cfg)


def append_points(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the stream to a Parquet folder; once: what is there now, then stop."""
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()
