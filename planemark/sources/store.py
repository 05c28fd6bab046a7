"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of one machine's session that names none, made when first needed.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Unset, it is a new folder of this machine's, if driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="planemark-"))


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """This package to the executors, once an application, for tasks that use its classes."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    # Served from a folder that lives as long as the application.
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='planemark-')}/{root.name}-{uuid.uuid4().hex[:8]}", "zip", root.parent, root.name))
    _sent.add(context.applicationId)


class Scratch:
    """Within `with Scratch() as s:` tables that written() and bucketed() make are deleted at the end, but for those given to s.keep(): for a
    caller that takes its results inside. Tables made outside any scope stay, as plans that nobody has run yet read them."""

    _open: ClassVar[list[Scratch]] = []

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """df, whose own table stays."""
        self.kept.add(getattr(df, "_written_at", ""))
        return df

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        Scratch._open.remove(self)
        discard(*(t for t in self.tables if t._written_at not in self.kept))  # type: ignore[attr-defined]

    @classmethod
    def note(cls, df: DataFrame) -> DataFrame:
        if cls._open:
            cls._open[-1].tables.append(df)
        return df


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder, so that rounds do not repeat earlier ones."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path  # type: ignore[attr-defined]
    return Scratch.note(out)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() gave and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if t is not None and path:
            if hasattr(t, "_table"):
                t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._table}")
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df from a table in the shared folder that is cut into buckets of `key`, as many as the session has shuffle partitions: joins and
    sums by the key then read it without an exchange. The table stands in the session's catalog until discard()."""
    spark = df.sparkSession
    table = f"planemark_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{table}"
    # Each task holds a bucket and so writes one file.
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._written_at, out._table = path, table  # type: ignore[attr-defined]
    return Scratch.note(out)
