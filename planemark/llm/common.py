"""Pieces that several operators share: the shared work folder, batches as numpy arrays, word and byte hashes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words: space, tab, LF, VT, FF, CR.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

U = np.uint64
#: The id that stands for a null doc_id in comparisons: after every other.
NO_ID = 2**63 - 1
#: Python workers give freed memory back to the system instead of keeping it beside a full JVM.
LEAN = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}

_shipped: dict[str, set[str]] = {}


def ship(spark: SparkSession, *files: str) -> None:
    """Send this package, and files that workers then find under SparkFiles, to the executors; once a Spark context."""
    context = spark.sparkContext
    done = _shipped.setdefault(context.applicationId, set())
    if "" not in done:
        context.environment.update(LEAN)
        root = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as own:
            packed = shutil.make_archive(f"{own}/{root.name}-{uuid.uuid4().hex[:8]}", "zip", root.parent, root.name)
            # Served from a copy that lives as long as the context.
            kept = f"{tempfile.mkdtemp(prefix=root.name)}/{Path(packed).name}"
            shutil.move(packed, kept)
        context.addPyFile(kept)
        done.add("")
    for f in files:
        if f not in done:
            context.addFile(f)
            done.add(f)


def shipped(path: str) -> str:
    """Where a worker finds a file given to ship()."""
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local default only where that is unset and there is
    one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or "/tmp/checkpoints/planemark"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of the writing query are released as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that stored() gave and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if t is not None and path:
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """df, or if it comes out of a shuffle, whose rows may come in another order when a task runs again, a stored copy."""
    return stored(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without a copy; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def parts(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose column "text" has about `limit` bytes (one longer text stands alone), with its bytes and offsets."""
    for batch in batches:
        data, offsets = view(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


# Hashes of byte ranges: polynomials over the prime field of 2**61 - 1, so that two given strings of n bytes share one with a chance
# of n / 2**61. (Modulo 2**64 some strings, as the Thue-Morse word and its complement, collide for every base.)

PRIME = U((1 << 61) - 1)
BASE = 0x1B873593CC9E2D51 % int(PRIME)
#: Bytes whose powers a worker keeps; longer texts make their own.
KEPT = (1 << 20) + 1
_powers: list[np.ndarray] = []


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo PRIME."""
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it."""
    a1, a0, b1, b0 = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & U(0x3FFFFFFF)) << U(31)) + a0 * b0)


def _series(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = times(out[:m], np.full(1, pow(base, k, int(PRIME)), U))
        k *= 2
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo PRIME for i < n or more."""
    inverse = pow(BASE, -1, int(PRIME))
    if n > KEPT:
        return _series(BASE, n), _series(inverse, n)
    if not _powers:
        _powers[:] = [_series(BASE, KEPT), _series(inverse, KEPT)]
    return _powers[0], _powers[1]


def range_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `ranged` makes the hash of any byte range."""
    n = len(data)
    up = powers(n + 1)[0]
    total = np.zeros(n + 1, dtype=U)
    carry = U(0)
    for a in range(0, n, 1 << 20):  # so that sums of 40-bit products stay far below 2**63, and temporaries small
        b = min(n, a + (1 << 20))
        codes = data[a:b].astype(U)
        codes += U(1)
        low = np.cumsum(codes * (up[a:b] & U(0xFFFFFFFF)), out=total[a + 1 : b + 1])
        codes *= up[a:b] >> U(32)
        high = np.cumsum(codes, out=codes)
        # Not the least residues: `ranged` reduces what it takes.
        low += (high & U(0x1FFFFFFF)) << U(32)
        high >>= U(29)
        low += high
        low += carry
        np.bitwise_and(low, PRIME, out=high)
        low >>= U(61)
        low += high
        carry = total[b]
    return total


def ranged(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes (below 2**61) of data[starts:ends]; equal for equal bytes wherever they stand."""
    down = powers(len(total))[1]
    return times(reduced(total[ends] + PRIME + PRIME - total[starts]), down[starts])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the two hashes in this order."""
    return mix(a * U(0xD6E8FEB86659FD93) + (b ^ (b >> U(32))))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the number of its first word (one more entry at the end)."""
    solid = ~IS_SPACE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    after = np.concatenate(([True], ~solid[:-1]))[: len(data)]
    before = np.concatenate((~solid[1:], [True]))[: len(data)]
    first = solid & (begins[:-1] | after)
    last = solid & (begins[1:] | before)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolling(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of hashes[i : i + size] for each i; the last size - 1 entries are missing. Windows are joined from halves of twice the
    length, so no step is linear in all of them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    part, width, out, have = mix(hashes + U((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)), 1, None, 0
    while True:
        if size & width:
            piece = part[have : have + n]
            out = piece if out is None else joined(out, piece)
            have += width
        width *= 2
        if width > size:
            return mix(out + U(size))  # type: ignore[operator]
        part = joined(part[: len(part) - width // 2], part[width // 2 :])


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of data[i : i + size] for each i; size is a multiple of 8. For filing, not for telling strings apart."""
    if len(data) < size:
        return np.zeros(0, U)
    raw = np.ascontiguousarray(data)
    part = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,)).astype(U)

    def light(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * U(0xD6E8FEB86659FD93)
        x += b
        x ^= x >> U(29)
        return x

    n, width, out, have = len(raw) - size + 1, 8, None, 0
    while True:
        if size & width:
            piece = part[have : have + n]
            out = piece if out is None else light(out, piece)
            have += width
        width *= 2
        if width > size:
            return mix(out)  # type: ignore[arg-type]
        part = light(part[: len(part) - width // 2], part[width // 2 :])


def within(firsts: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the windows of `size` consecutive words that lie inside one document. firsts: as from words()."""
    counts = np.maximum(np.diff(firsts) - size + 1, 0)
    total = int(counts.sum())
    base = np.repeat(firsts[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return base + np.arange(total)


def cover(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie in [s, s + size) for some s."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + size, n), 1)
    return np.cumsum(edge[:-1]) > 0
