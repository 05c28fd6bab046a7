"""Suffix-array dedup: bytes covered by strings of `size` bytes that also start elsewhere.

Shards are cut by content: every window of `size` bytes is filed under the leftmost smallest hash of its shorter grams (its anchor), so
equal windows meet in one shard wherever they stand. Windows that follow one another under one anchor travel as one segment; of
equal segments one stands for all. Each shard's segments go into one suffix array made by induced sorting, and permuted common
prefixes show the windows that stand there twice. Anchors with very many different segments are cut further, by the bytes that a
block of their windows has in common, and at last by the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, U, discard, grams, mix, parts, range_hashes, ranged, read, ship, stored
from .packed import text_bytes, _arrow
from .substrings import _ids, _shard, _source, row_filter, row_keys
from .suffix_array import shared_windows

#: As long as a text of Spark can be. The rest of a hash orders grams; of grams alike in it the first one of a window counts, in every text.
PLACE_BITS = 31
PLACE = U((1 << PLACE_BITS) - 1)
#: Different segments of one anchor up to which they go into one shard; beyond, windows in blocks of BLOCKS are cut apart.
MOST, BLOCKS = 1200, (32, 1)
SHARD_BYTES = 700_000
#: Bytes of text hashed at a time.
PART = 1 << 19
SEGMENTS = "anchor long, content long, row_key long, row_id long, start long, windows long, before long"


def gram_size(size: int) -> int:
    """Two fifths of a window: longer grams are rarer, so fewer segments that only share one are sorted; shorter ones make longer and
    so fewer segments."""
    return max(32, 2 * size // 5 // 8 * 8)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, U(2**64 - 1), U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def _emit(rows: np.ndarray, anchors: np.ndarray, total: np.ndarray, at: np.ndarray, windows: np.ndarray, before: np.ndarray, offsets: np.ndarray, keys: np.ndarray, ids: np.ndarray, size: int) -> pa.RecordBatch:
    content = mix(ranged(total, at, at + windows + size - 1) ^ mix(windows.astype(U)))
    cols = [anchors.view(np.int64), content.view(np.int64), keys[rows].view(np.int64), ids[rows], at - offsets[rows], windows, before]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in cols], [x.split()[0] for x in SEGMENTS.split(", ")])


def _segments(docs: DataFrame, size: int) -> DataFrame:
    """Runs of windows with one anchor: its hash, a hash of the run's bytes, and the place."""
    gram = gram_size(size)
    width = size - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in parts(batches, PART):
            if len(data) < size:
                continue
            hashes = grams(data, gram)
            least = sliding_least((hashes & ~PLACE) | np.arange(len(hashes), dtype=U), width)
            # Windows that lie within one document.
            counts = np.maximum(np.diff(offsets) - size + 1, 0)
            if not counts.any():
                continue
            base = offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1]))
            s = np.repeat(base.astype(np.int32), counts) + np.arange(int(counts.sum()), dtype=np.int32)
            anchor = (least[s] & PLACE).astype(np.int32)
            del least
            new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            new[(np.cumsum(counts) - counts)[counts > 0]] = True
            cut = np.flatnonzero(new)
            first, a = s[cut].astype(np.int64), anchor[cut].astype(np.int64)
            windows = np.diff(np.append(cut, len(s)))
            del s, anchor, new
            rows = np.searchsorted(offsets, first, "right") - 1
            total = range_hashes(data)
            keys, ids = row_keys(_ids(batch), total, offsets), _ids(batch)
            yield _emit(rows, hashes[a], total, first, windows, a - first, offsets, keys, ids, size)

    return _source(docs).mapInArrow(run, SEGMENTS)


def _rows(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Numbers of the rows of each (row_key, row_id)."""
    keys, ids = table.column("row_key").to_numpy(), table.column("row_id").to_numpy()
    order = np.lexsort((ids, keys))
    if not len(order):
        return {}
    cut = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (ids[order][1:] != ids[order][:-1]))))
    return {(int(keys[order[a]]), int(ids[order[a]])): order[a:b] for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True)}


def _own_rows(batch: pa.RecordBatch, rows: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the batch and numbers of the rows that belong to them, pair by pair."""
    found = [(i, r) for i, k in enumerate(zip(batch.column("row_key").to_numpy().tolist(), _ids(batch).tolist(), strict=True)) if (r := rows.get(k)) is not None]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat([i for i, _ in found], [len(r) for _, r in found]), np.concatenate([r for _, r in found])


def _cut(sharded: DataFrame, segments: DataFrame, shards: int, size: int, block: int) -> DataFrame:
    """The segments cut into blocks of windows, by their distance from the anchor, filed by the bytes that all windows of the block
    would have in common."""

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        rows = _rows(given)
        starts, windows, before, anchors = (given.column(c).to_numpy() for c in ("start", "windows", "before", "anchor"))
        for batch, data, offsets in parts(iter(own.to_batches()), PART):
            doc, r = _own_rows(batch, rows)
            if not len(r):
                continue
            # Distances from the anchor run from `before` down to before - windows + 1.
            high, low = before[r] // block, (before[r] - windows[r] + 1) // block
            n = high - low + 1
            k = np.repeat(np.arange(len(r)), n)
            b = low[k] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            far = np.minimum(b * block + block - 1, before[r][k])
            near = np.maximum(b * block, (before[r] - windows[r] + 1)[k])
            total = range_hashes(data)
            anchor_at = offsets[doc][k] + (starts[r] + before[r])[k]
            core = ranged(total, anchor_at - b * block, anchor_at - (b * block + block - 1) + size)
            name = mix(mix(anchors[r][k].view(U) ^ mix(core)) + b.astype(U) * U(1024) + U(block))
            out.append(_emit(doc[k], name, total, anchor_at - far, far - near + 1, far, offsets, batch.column("row_key").to_numpy().view(U), _ids(batch), size))
        return pa.Table.from_batches(out, schema=_arrow(SEGMENTS))

    given = segments.select(*(x.split()[0] for x in SEGMENTS.split(", ")), F.pmod(_unsigned_mod("row_key", shards), F.lit(shards)).cast("int").alias("bucket"))
    return sharded.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(run, SEGMENTS)


def _unsigned_mod(column: str, n: int):  # type: ignore[no-untyped-def]
    """column modulo n as an unsigned 64-bit number, plus a multiple of n."""
    high = F.shiftrightunsigned(column, 1) % n
    return high * 2 + F.col(column).bitwiseAND(1)


def _repeated(segments: DataFrame) -> DataFrame:
    """Segments of anchors under which two or more stand; no other can hold a string that starts elsewhere.

    Most anchors stand once, so what is exchanged and kept after this is small. Anchors are counted alone, before segments move.
    """
    anchors = stored(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    place = F.col("start") * (1 << 32) + F.col("windows") * (1 << 16) + F.col("before")
    moved = segments.select("anchor", "content", "row_key", "row_id", place.alias("place")).join(anchors, "anchor", "left_semi")
    out = stored(moved.select("anchor", "content", "row_key", "row_id", *_unpacked("place")), "segments")
    discard(segments, anchors)
    return out


def _unpacked(place: str) -> list[Column]:
    low = lambda c: c.bitwiseAND(F.lit(65535).cast("long"))
    at = F.col(place)
    return [F.shiftright(at, 32).alias("start"), low(F.shiftright(at, 16)).alias("windows"), low(at).alias("before")]


def _classes(segments: DataFrame) -> DataFrame:
    """One row for each different segment of anchors under which any two stand, with a representative and counts.

    Segments are counted before they meet by anchor, and then travel once: a window over the anchor counts its kinds. A segment's place,
    windows and distance from its anchor, which are below 2**31 and 2**16, travel as one number.
    """
    place = F.col("start") * (1 << 32) + F.col("windows") * (1 << 16) + F.col("before")
    by_content = segments.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row_key", "row_id", place.alias("place"))).alias("rep"))
    of_anchor = Window.partitionBy("anchor")
    counted = by_content.select("*", F.count(F.lit(1)).over(of_anchor).alias("kinds"), F.sum("copies").over(of_anchor).alias("all_copies")).where("all_copies > 1")
    return counted.select("anchor", "content", "copies", "kinds", "rep.row_key", "rep.row_id", *_unpacked("rep.place"))


def _fetched(sharded: DataFrame, reps: DataFrame, shards: int, arrays: int, size: int) -> DataFrame:
    """The bytes of the representatives, by the array that they go into."""
    schema = "bucket int, anchor long, content long, copies long, bytes binary"

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        rows = _rows(given)
        names = [given.column(c).to_numpy() for c in ("array", "anchor", "content", "copies")]
        starts, lengths = given.column("start").to_numpy(), given.column("windows").to_numpy() + size - 1
        seen = set()
        for batch, data, offsets in parts(iter(own.to_batches()), PART):
            raw = data.tobytes()
            for i, r in zip(*(x.tolist() for x in _own_rows(batch, rows)), strict=True):
                if r not in seen:  # repeated rows have one representative
                    seen.add(r)
                    at = int(offsets[i] + starts[r])
                    for c, x in zip(cols, (*(int(n[r]) for n in names), raw[at : at + int(lengths[r])]), strict=True):
                        c.append(x)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), *[pa.int64()] * 3, pa.binary()], strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    given = reps.withColumn("array", F.pmod(F.xxhash64("anchor"), F.lit(arrays)).cast("int")).withColumn("bucket", F.pmod(_unsigned_mod("row_key", shards), F.lit(shards)).cast("int"))
    return sharded.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(run, schema)


RUNS = "anchor long, content long, run_starts array<long>, run_lengths array<long>"


def _sorted_shards(fetched: DataFrame, size: int) -> DataFrame:
    """Runs of windows, within the segments that have no copy, that another segment of the shard has."""

    def run(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        column = table.column("bytes").combine_chunks()
        lengths = np.array([len(x.as_buffer()) for x in column], np.int64)
        raw = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in column]) if len(column) else np.zeros(0, np.uint8)
        hit = shared_windows(raw, lengths, size)
        ends = np.cumsum(lengths)
        for a, c, copies, begin, end in zip(*(table.column(x).to_pylist() for x in ("anchor", "content", "copies")), (ends - lengths).tolist(), ends.tolist(), strict=True):
            own = hit[begin:end]
            if copies == 1 and own.any():
                edge = np.diff(np.concatenate(([False], own, [False])).astype(np.int8))
                first = np.flatnonzero(edge == 1)
                for k, x in enumerate((a, c, first, np.flatnonzero(edge == -1) - first)):
                    out[k].append(x)
        longs = pa.list_(pa.int64())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), longs, longs), strict=True)], names=[x.split()[0] for x in RUNS.split(", ")])

    return fetched.groupBy("bucket").applyInArrow(run, RUNS)


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, span_starts array<long>, span_lengths array<long>, kept_sha256 string"


def whole_words(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The range without a part of a word at either end."""
    if a and not IS_SPACE[text[a - 1]]:
        while a < b and not IS_SPACE[text[a]]:
            a += 1
    if b < len(text) and not IS_SPACE[text[b]]:
        while b > a and not IS_SPACE[text[b - 1]]:
            b -= 1
    return a, b


def repeated_bytes(docs: DataFrame, size: int = 400, keep_text: bool = False, least_words: int = 0) -> DataFrame:
    """For every row of `docs` (doc_id, text) the maximal runs of bytes that lie in `size`-byte strings which also start elsewhere,
    in this or another row, and what is kept; with keep_text also kept_text, where bytes that no longer make UTF-8 are dropped, and given_sha256 of the whole text.

    With least_words, runs lose the parts of words at their ends, and those of fewer whole words stay. Null or empty text has no bytes; texts of any length are read whole. Repeated rows repeat
    one another; null ids are ids. Extra columns, whatever their names, are left out; an empty table gives an empty result. Segments
    count as equal by the hash of their gram and one over a prime field of 2**61 - 1; all else is compared byte by byte in the arrays.
    """
    if not 48 <= size <= 65536:
        raise ValueError("size must be from 48 to 65536")
    ship(docs.sparkSession)
    shards = max(8, text_bytes(docs) // (8 << 20))
    sharded = _shard(docs, shards)
    segments = _repeated(stored(_segments(docs, size), "segments"))
    classes = stored(_classes(segments), "classes")
    marked = []
    for block in (*BLOCKS, 0):
        # One window is a segment that equals all others of its name: it needs no array.
        many = classes.where((F.col("kinds") > MOST) & F.lit(block > 0))
        few = classes.where((F.col("kinds") <= MOST) | F.lit(block == 0))
        reps = few.where("kinds > 1")
        n_bytes = reps.agg(F.sum(F.col("windows") + size - 1)).first()[0] or 0
        everywhere = few.where("copies > 1").select("anchor", "content", F.array(F.lit(0).cast("long")).alias("run_starts"), F.array("windows").alias("run_lengths"))
        runs = everywhere
        if n_bytes:
            fetched = _fetched(_shard(docs, shards, row_filter(reps)), reps, shards, max(1, n_bytes // SHARD_BYTES), size)
            runs = runs.unionByName(_sorted_shards(fetched, size))
        marked.append(stored(segments.join(runs, ["anchor", "content"]).select("row_key", "row_id", "start", "run_starts", "run_lengths"), "marked"))
        before = segments, classes
        if many.isEmpty():
            discard(*before)
            break
        hot = segments.join(many.select("anchor").distinct(), "anchor", "left_semi")
        segments = stored(_cut(_shard(docs, shards, row_filter(hot)), hot, shards, size, block), "segments")
        discard(*before)
        segments = _repeated(segments)
        classes = stored(_classes(segments), "classes")
    places = marked[0]
    for m in marked[1:]:
        places = places.unionByName(m)
    places = places.withColumn("bucket", F.pmod(_unsigned_mod("row_key", shards), F.lit(shards)).cast("int"))
    schema = SPANS + (", kept_text string, given_sha256 string" if keep_text else "")

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(8)]
        rows = _rows(found)
        begin = found.column("start").to_numpy() if found.num_rows else np.zeros(0, np.int64)
        firsts, lengths = found.column("run_starts").to_pylist(), found.column("run_lengths").to_pylist()
        for batch, data, offsets in parts(iter(own.to_batches()), PART):
            raw = data.tobytes()
            for i, k in enumerate(zip(batch.column("row_key").to_numpy().tolist(), _ids(batch).tolist(), strict=True)):
                text = raw[int(offsets[i]) : int(offsets[i + 1])]
                edge = np.zeros(len(text) + 1, np.int32)
                for r in rows.get(k, ()):
                    a = np.array(firsts[r], np.int64) + begin[r]
                    np.add.at(edge, a, 1)
                    np.subtract.at(edge, a + np.array(lengths[r], np.int64) + size - 1, 1)
                gone = np.cumsum(edge[:-1]) > 0
                step = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
                first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                if least_words and len(first):
                    whole = [whole_words(text, a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    whole = [(a, b) for a, b in whole if len(text[a:b].split()) >= least_words]
                    gone[:] = False
                    for a, b in whole:
                        gone[a:b] = True
                    first, last = (np.array([w[k] for w in whole], np.int64) for k in (0, 1))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(first) else text
                for c, x in zip(cols, (len(text), int(gone.sum()), len(first), first, last - first, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None, hashlib.sha256(text).hexdigest() if keep_text else None), strict=True):
                    c.append(x)
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), longs, longs, pa.string(), pa.string(), pa.string()]
        made = [pa.array(c, k) for c, k in zip(cols[: 8 if keep_text else 6], kinds, strict=False)]
        return pa.Table.from_arrays([own.column("doc_id").combine_chunks(), *made], names=[x.split()[0] for x in schema.split(", ")])

    return sharded.groupBy("bucket").cogroup(places.groupBy("bucket")).applyInArrow(run, schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start elsewhere too; nulls and repeats as in repeated_bytes."""
    return repeated_bytes(read(spark, sf_dir, "documents"), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS MATERIALIZED (
  SELECT rid, pos, hex(b[pos:pos]) AS byte, CASE WHEN pos + 399 <= octet_length(b) THEN md5(b[pos:pos + 399]) END AS said
  FROM (SELECT rid, b, unnest(range(1, octet_length(b) + 1)) AS pos FROM docs)
), repeated AS (SELECT said FROM bytes WHERE said IS NOT NULL GROUP BY said HAVING count(*) > 1),
marked AS (
  SELECT rid, pos, byte, coalesce(pos - max(CASE WHEN r.said IS NOT NULL THEN pos END) OVER (PARTITION BY rid ORDER BY pos) < 400, false) AS gone
  FROM bytes LEFT JOIN repeated r ON r.said = bytes.said
), edged AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY rid ORDER BY pos) AS opens FROM marked),
kept AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone) AS stays
  FROM edged GROUP BY rid
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(stays, ''))) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.rid = docs.rid
"""
