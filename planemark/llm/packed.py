"""Exchanges of very many small entries between documents and buckets of keys.

Rows of one entry each would cost several times their content in a shuffle, so the entries of many documents are packed into one
binary value for each bucket: headers of the documents, the number of entries of each, and columns of entries.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 1 << 20
SCHEMA = "bucket int, payload binary"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bits_for(n_bytes: int, each: int) -> int:
    """Bits of as many buckets as n_bytes need at about `each` bytes a bucket, at least 8 buckets."""
    return max(3, math.ceil(math.log2(max(1, n_bytes / each))))


def pack(headers: list[np.ndarray], counts: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """headers: 64-bit values for each document; columns: unsigned values for each entry, in the documents' order."""
    out = [struct.pack("<IIBB", len(counts), len(columns[0]), len(headers), len(columns))]
    out += [np.ascontiguousarray(h).view(np.uint64).tobytes() for h in headers]
    out.append(counts.astype(np.uint32).tobytes())
    for c in columns:
        if c.dtype == np.uint32 and (not len(c) or c.max() < 65536):
            c = c.astype(np.uint16)
        out += [bytes([c.dtype.itemsize]), c.tobytes()]
    return b"".join(out)


def unpack(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The same of many payloads one after another; entries of 2 or 4 bytes as 32-bit, others as 64-bit values."""
    headers: list[list] = []
    columns: list[list] = []
    counts = []
    for raw in payloads:
        r, n, nh, nc = struct.unpack_from("<IIBB", raw)
        at = 10
        for k in range(nh):
            if len(headers) <= k:
                headers.append([])
            headers[k].append(np.frombuffer(raw, np.uint64, r, at))
            at += 8 * r
        counts.append(np.frombuffer(raw, np.uint32, r, at))
        at += 4 * r
        for k in range(nc):
            size = raw[at]
            c = np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: np.uint64}[size], n, at + 1)
            at += 1 + size * n
            if len(columns) <= k:
                columns.append([])
            columns[k].append(c.astype(np.uint32) if size == 2 else c)
    return [np.concatenate(h) for h in headers], np.concatenate(counts).astype(np.int64), [np.concatenate(c) for c in columns]


def split(buckets: np.ndarray, headers: list[np.ndarray], rows: np.ndarray, columns: list[np.ndarray], also: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One packed value for each bucket. rows: the document of each entry, ascending; also: a bucket in which each document appears
    even without entries."""
    if also is not None:
        # Entries that stand for the documents themselves are cut off again below.
        n = len(buckets)
        order = np.lexsort((np.concatenate((rows, np.arange(len(also)))), np.concatenate((buckets, also))))
        all_buckets, all_rows = np.concatenate((buckets, also))[order], np.concatenate((rows, np.arange(len(also))))[order]
        real = order < n
        order = order[real]
    else:
        order = np.argsort(buckets, kind="stable")
        all_buckets, all_rows, real = buckets[order], rows[order], np.ones(len(order), bool)
    if not len(all_buckets):
        return
    cuts = np.flatnonzero(np.concatenate(([True], all_buckets[1:] != all_buckets[:-1])))
    ends = np.append(cuts[1:], len(all_buckets))
    before = np.concatenate(([0], np.cumsum(real)))
    columns = [c[order] for c in columns]
    ids, payloads = [], []
    for a, b in zip(cuts, ends, strict=True):
        own = all_rows[a:b]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        docs = own[first]
        counts = np.add.reduceat(real[a:b].astype(np.int64), first)
        ids.append(int(all_buckets[a]))
        payloads.append(pack([h[docs] for h in headers], counts, [c[before[a] : before[b]] for c in columns]))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


class Gather:
    """Collects documents and entries until there are enough to be split."""

    def __init__(self) -> None:
        self.headers: list[list[np.ndarray]] = []
        self.rows: list[np.ndarray] = []
        self.buckets: list[np.ndarray] = []
        self.columns: list[list[np.ndarray]] = []
        self.also: list[np.ndarray] = []
        self.n = self.docs = 0

    def add(self, headers: list[np.ndarray], buckets: np.ndarray, rows: np.ndarray, columns: list[np.ndarray], also: np.ndarray | None = None) -> None:
        self.headers.append(headers)
        self.rows.append(rows + self.docs)
        self.buckets.append(buckets)
        self.columns.append(columns)
        if also is not None:
            self.also.append(also)
        self.docs += len(headers[0])
        self.n += len(rows)

    def full(self) -> bool:
        return self.n >= FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.docs:
            headers = [np.concatenate(x) for x in zip(*self.headers, strict=True)]
            columns = [np.concatenate(x) for x in zip(*self.columns, strict=True)]
            yield from split(np.concatenate(self.buckets), headers, np.concatenate(self.rows), columns, np.concatenate(self.also) if self.also else None)
        self.__init__()  # type: ignore[misc]


def by_bucket(packed: DataFrame, fold: Callable[[int, list[np.ndarray], np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str = SCHEMA) -> DataFrame:
    """fold(bucket, headers, counts, columns) for everything that was packed for a bucket; gives record batches of schema."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        headers, counts, columns = unpack([x.as_py() for x in table.column("payload")])
        return pa.Table.from_batches(list(fold(key[0].as_py(), headers, counts, columns)), schema=_arrow(schema))

    return packed.groupBy("bucket").applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
