"""Substring dedup by fixed-block anchors: non-overlapping reference blocks are indexed and probed with every rolling window; hits
are extended to maximal exact repeats.

A window of `size` words contains a whole block of size // 2 + 1 words, wherever it starts, if blocks begin at every multiple of
that number. So a repeat is found by its block; only there the windows around are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, U, cover, mix, parts, range_hashes, ranged, read, rolling, ship, stored, within, words
from .packed import SCHEMA, Gather, bits_for, by_bucket, split, text_bytes, unpack, _arrow


def row_keys(ids: np.ndarray, total: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key for each row by its id and text. Equal rows share one: they are treated equally."""
    return mix(mix(ids.view(U)) ^ ranged(total, offsets[:-1], offsets[1:]) ^ np.diff(offsets).astype(U))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    total = range_hashes(data)
    starts, ends, firsts = words(data, offsets)
    return total, starts, ends, firsts, mix(ranged(total, starts, ends))


def _probe(docs: DataFrame, block: int, bits: int) -> DataFrame:
    """Every rolling window of `block` words, packed by the upper bits of its hash, with 32 further bits and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather()
        for batch, data, offsets in parts(batches):
            total, _, _, firsts, hashes = _word_hashes(data, offsets)
            at = within(firsts, block)
            keys = rolling(hashes, block)[at] if len(at) else np.zeros(0, U)
            rows = np.searchsorted(firsts, at, "right") - 1
            ids = _ids(batch)
            gather.add([row_keys(ids, total, offsets), ids], (keys >> U(64 - bits)).astype(np.int32), rows, [(keys & U(0xFFFFFFFF)).astype(np.uint32), (at - firsts[rows]).astype(np.uint32)])
            if gather.full():
                yield from gather.flush()
        yield from gather.flush()

    return _source(docs).mapInArrow(run, SCHEMA)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts keys, where groups of equal ones begin in it, and the group of each sorted entry."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _back(hits: np.ndarray, headers: list[np.ndarray], rows: np.ndarray, at: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Places of hits, packed by the shard of their documents."""
    rows, at = rows[hits], at[hits].astype(np.uint32)
    used, rows = np.unique(rows, return_inverse=True)
    heads = [h[used] for h in headers]
    yield from split((heads[0] % U(shards)).astype(np.int32)[rows], heads, rows, [at])


def _anchored(packed: DataFrame, block: int, shards: int) -> DataFrame:
    """Probes that meet a block of a document with a smaller id, and the blocks that they meet."""

    def fold(_: int, headers: list[np.ndarray], counts: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, at = columns
        rows = np.repeat(np.arange(len(counts)), counts)
        ids = headers[1].view(np.int64)[rows]
        order, begins, group = _groups(keys)
        ids_in, block_in = ids[order], at[order] % block == 0
        least = np.minimum.reduceat(np.where(block_in, ids_in, NO_ID), begins)[group] if len(order) else ids_in
        most = np.maximum.reduceat(ids_in, begins)[group] if len(order) else ids_in
        hit = np.zeros(len(keys), bool)
        hit[order] = (ids_in > least) | (block_in & (ids_in < most))
        yield from _back(hit, headers, rows, at, shards)

    return by_bucket(packed, fold)


SLOT_BITS = 22


def row_filter(rows: DataFrame) -> np.ndarray:
    """A bit for each of 2**22 ranges of row keys, set if rows (row_key) have one of it: half a megabyte whatever their number.

    It spares the shuffle of texts that are not asked for; where very many are, it is full and spares nothing.
    """
    slot = F.shiftrightunsigned("row_key", 64 - SLOT_BITS)
    words_ = rows.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(shiftrightunsigned(row_key, 42) & 31 AS INT))")).alias("b")).collect()
    out = np.zeros(1 << (SLOT_BITS - 5), np.uint32)
    out[[r["w"] for r in words_]] = [r["b"] for r in words_]
    return out


def _shard(docs: DataFrame, shards: int, only: np.ndarray | None = None) -> DataFrame:
    """Adds row_key and bucket (its shard) to docs; only: as from row_filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in parts(batches):
            key = row_keys(_ids(batch), range_hashes(data), offsets)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(key.view(np.int64)), pa.array((key % U(shards)).astype(np.int32))], ["doc_id", "text", "row_key", "bucket"])
            if only is not None:
                slot = (key >> U(64 - SLOT_BITS)).astype(np.int64)
                out = out.filter(pa.array((only[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1))
            yield out

    return _source(docs).mapInArrow(run, "doc_id long, text string, row_key long, bucket int")


def _places(hits: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Sorted distinct places of hits by row key and id."""
    if not hits.num_rows:
        return {}
    headers, counts, (at,) = unpack([x.as_py() for x in hits.column("payload")])
    rows = np.repeat(np.arange(len(counts)), counts)
    keys = list(zip(headers[0].tolist(), headers[1].view(np.int64).tolist(), strict=True))
    names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    name = np.array([names[k] for k in keys], np.int64)[rows] if len(rows) else np.zeros(0, np.int64)
    pair = np.unique((name << 32) | at.astype(np.int64))
    cuts = np.searchsorted(pair, np.arange(len(names) + 1) << 32)
    return {k: pair[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF for k, i in names.items()}


def _extended(docs: DataFrame, hits: DataFrame, size: int, block: int, bits: int) -> DataFrame:
    """Windows of `size` words around the hits, packed by the upper bits of one hash, with another hash of 64 bits."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        places = _places(found)
        if places and own.num_rows:
            gather = Gather()
            for batch, data, offsets in parts(iter(own.to_batches())):
                _, _, _, firsts, hashes = _word_hashes(data, offsets)
                keys, ids = batch.column("row_key").to_numpy().view(U), _ids(batch)
                rows, starts = [], []
                for i, k in enumerate(zip(keys.tolist(), ids.tolist(), strict=True)):
                    n = int(firsts[i + 1] - firsts[i]) - size + 1
                    if n > 0 and k in places:
                        # Windows that contain the block at a hit.
                        s = np.flatnonzero(cover(n, np.maximum(places[k] - (size - block), 0), size - block + 1))
                        starts.append(s + firsts[i])
                        rows.append(np.full(len(s), i))
                row, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts))
                first, second = (rolling(hashes, size, seed)[start] if len(start) else np.zeros(0, U) for seed in (1, 2))
                gather.add([keys, ids], (second >> U(64 - bits)).astype(np.int32), row, [first, (start - firsts[row]).astype(np.uint32)])
                if gather.full():
                    out += gather.flush()
            out += gather.flush()
        return pa.Table.from_batches(out, schema=_arrow(SCHEMA))

    return docs.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(run, SCHEMA)


def _repeated(packed: DataFrame, shards: int) -> DataFrame:
    """Windows whose words also start in a document with a smaller id."""

    def fold(_: int, headers: list[np.ndarray], counts: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, at = columns
        rows = np.repeat(np.arange(len(counts)), counts)
        ids = headers[1].view(np.int64)[rows]
        order, begins, group = _groups(keys)
        hit = np.zeros(len(keys), bool)
        if len(order):
            hit[order] = ids[order] > np.minimum.reduceat(ids[order], begins)[group]
        yield from _back(hit, headers, rows, at, shards)

    return by_bucket(packed, fold)


SPANS = "doc_id long, n_words long, n_removed long, n_spans long, span_starts array<long>, span_lengths array<long>, kept_sha256 string"


def repeated_spans(docs: DataFrame, size: int = 13, keep_text: bool = False) -> DataFrame:
    """For every row of `docs` (doc_id, text), the maximal runs of words that lie in windows of `size` words which also start in a
    row with a smaller doc_id, what is kept, and with keep_text also kept_text (words joined by a space).

    Null or empty text has no words; a null doc_id counts as greater than all others, and such rows are not compared with one
    another; neither are rows of equal ids. Extra columns are left out; an empty table gives an empty result. Windows are compared
    by 64 bits of one hash and the bucket's bits of another.
    """
    ship(docs.sparkSession)
    block = size // 2 + 1
    n_bytes = text_bytes(docs)
    bits, shards = bits_for(n_bytes, 12 << 20), max(8, n_bytes // (8 << 20))
    anchors = stored(_anchored(_probe(docs, block, bits), block, shards), "anchors")
    sharded = _shard(docs, shards)
    repeats = stored(_repeated(_extended(sharded, anchors, size, block, bits), shards), "repeats")
    schema = SPANS + (", kept_text string" if keep_text else "")

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        places = _places(found)
        cols: list[list] = [[] for _ in range(8)]
        for batch, data, offsets in parts(iter(own.to_batches())):
            starts, ends, firsts = words(data, offsets)
            raw = data.tobytes()
            for i, k in enumerate(zip(batch.column("row_key").to_numpy().view(U).tolist(), _ids(batch).tolist(), strict=True)):
                a, b = int(firsts[i]), int(firsts[i + 1])
                gone = cover(b - a, places[k], size) if k in places else np.zeros(b - a, bool)
                edges = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
                begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                stay = np.flatnonzero(~gone) + a
                kept = b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                for c, x in zip(cols, (b - a, int(gone.sum()), len(begin), begin, end - begin, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None), strict=False):
                    c.append(x)
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), longs, longs, pa.string(), pa.string()]
        made = [pa.array(c, k) for c, k in zip(cols[: 7 if keep_text else 6], kinds, strict=False)]
        return pa.Table.from_arrays([own.column("doc_id").combine_chunks(), *made], names=[x.split()[0] for x in schema.split(", ")])

    return sharded.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that start in an earlier one; nulls and repeats as in repeated_spans."""
    return repeated_spans(read(spark, sf_dir, "documents"), 13).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents
), words AS MATERIALIZED (SELECT rid, id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
windows AS MATERIALIZED (
  SELECT * FROM (SELECT rid, id, n, pos, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS said FROM words) WHERE pos + 12 <= n
), earliest AS (SELECT said, min(id) AS id FROM windows GROUP BY said),
gone AS (
  SELECT DISTINCT rid, pos + g.k AS pos FROM windows w JOIN earliest e ON e.said = w.said AND e.id < w.id, generate_series(0, 12) g(k)
), kept AS (
  SELECT w.rid, count(g.pos) AS n_removed, string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL) AS stays
  FROM words w LEFT JOIN gone g ON g.rid = w.rid AND g.pos = w.pos GROUP BY w.rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(stays, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.rid = docs.rid
"""
