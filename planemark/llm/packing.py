"""Best-fit packing by a linear grouping scheme: large lengths are rounded up within groups of equal cardinality, configurations
of these few sizes are optimised, actual documents take the places of the rounded ones, and small ones are best-fitted.

All that the driver plans with is a histogram of at most `capacity` lengths and intervals of like sequences; its size does not
grow with the number of documents. Rows find their places on the executors.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, ship, shipped, stored

CAPACITY = 2048
EOT = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words of up to so many characters are remembered, up to so many of them in a worker.
LONGEST, REMEMBERED = 48, 900_000
#: Marks that end a word; plain letters before them are encoded apart from them.
MARKS = ".,;:!?#*%&$|<>()[]{}\"-_/+=~^@"

_state: dict = {}


def word_ids(texts: list[str], tokenizer_path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text. Words between spaces and line ends are encoded once and remembered.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its words in order.
    """
    if _state.get("path") != tokenizer_path:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state.update(path=tokenizer_path, tokenizer=Tokenizer.from_file(tokenizer_path), known={"": b""})
    known = _state["known"]
    split = [t.replace("\n", " ").split(" ") for t in texts]
    new = set().union(*split).difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        known[""] = b""
        new = set().union(*split).difference(known)
    order = list(new)
    # A run of ASCII letters is a unit of its own, in lower case: most new words are known ones with a capital or marks. Others may
    # change with what follows them (as a capital I with a dot, whose dot joins the marks), so they are encoded as they stand.
    units = {}
    for w in order:
        core = w.rstrip(MARKS)
        if core.isascii() and core.isalpha():
            units[w] = (core.lower(), w[len(core) :])
    wanted = {x for pair in units.values() for x in pair}
    wanted.update(w for w in order if w not in units)
    missing = [w for w in wanted if w not in known]
    for at in range(0, len(missing), 4096):
        some = missing[at : at + 4096]
        for w, e in zip(some, _state["tokenizer"].encode_batch_fast(some, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
    for w, (core, marks) in units.items():
        known[w] = known[core] + known[marks]
    out = [b"".join(map(known.__getitem__, words)) for words in split]
    for w in {*order, *missing}:
        if len(w) > LONGEST:
            del known[w]
    return out


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eot: int = EOT, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every row of `docs` (doc_id, text), each text followed by the id `eot`.

    Null or empty text: the end id alone. keep_ids adds the column ids.
    """
    ship(docs.sparkSession, tokenizer_path)
    end = array("I", [eot]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                cols: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(some.column("doc_id").to_pylist(), word_ids([x or "" for x in some.column("text").to_pylist()], shipped(tokenizer_path)), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        for c, x in zip(cols, (doc, piece, start // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if keep_ids else None), strict=True):
                            c.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                n = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


# The plan: everything below works on counts of lengths.


def best_configuration(values: np.ndarray, sizes: list[int], most: list[int], capacity: int) -> tuple[float, list[int]]:
    """How many of each size (at most `most`) fit into capacity with the greatest sum of values."""
    best = np.zeros(capacity + 1)
    steps = []
    for g, (size, limit) in enumerate(zip(sizes, most, strict=True)):
        limit = min(limit, capacity // size)
        k = 1
        while limit > 0 and values[g] > 0:
            k = min(k, limit)
            limit -= k
            w = k * size
            taken = np.zeros(capacity + 1, bool)
            with_ = best[: capacity + 1 - w] + k * values[g]
            taken[w:] = with_ > best[w:] + 1e-12
            new = best.copy()
            new[w:][taken[w:]] = with_[taken[w:]]
            steps.append((g, k, w, taken))
            best = new
            k *= 2
    out, room = [0] * len(sizes), capacity
    for g, k, w, taken in reversed(steps):
        if taken[room]:
            out[g] += k
            room -= w
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with their multiplicities that hold `demand` items of each of a few sizes.

    The linear programme over all configurations is solved by generating columns (the simplex method with a knapsack to price) until
    less than one sequence could be gained; its solution is rounded down, and what is left is packed by one fullest configuration
    after another.
    """
    n = len(sizes)
    basis = [[0] * g + [max(1, min(capacity // sizes[g], demand[g]))] + [0] * (n - g - 1) for g in range(n)]
    x = np.array([demand[g] / basis[g][g] for g in range(n)], float)
    free = [capacity] * n
    met = set()
    # A basis that comes again would come for ever: no step gains anything any more.
    while (key := frozenset(map(tuple, basis))) not in met:
        met.add(key)
        matrix = np.array(basis, float).T
        prices = np.linalg.solve(matrix.T, np.ones(n))
        value, column = best_configuration(prices, sizes, free, capacity)
        # Prices over value are feasible, so no solution is below sum(x) / value.
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) < 0.5:
            break
        step = np.linalg.solve(matrix, np.array(column, float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[out] = column
    left = list(demand)
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(column: list[int], times: int) -> None:
        times = min([times, *(left[g] // c for g, c in enumerate(column) if c)])
        if times > 0 and any(column):
            plan.append((tuple(column), times))
            for g, c in enumerate(column):
                left[g] -= c * times

    for k in np.argsort(-x):
        use(basis[k], int(x[k] + 1e-6))
    while any(left):
        _, column = best_configuration(np.array(sizes, float), sizes, left, capacity)
        use(column, max(left))
    return plan


class Rooms:
    """Like sequences by what is free in them: (how many, what they hold as nested pairs, the last piece outside)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_free: list[list[tuple[int, tuple | None]]] = [[] for _ in range(capacity + 1)]
        self.filled: list[int] = []  # those that are not empty, without 0

    def put(self, free: int, count: int, held: tuple | None) -> None:
        if count:
            if free and not self.by_free[free]:
                bisect.insort(self.filled, free)
            self.by_free[free].append((count, held))

    def fit(self, length: int, left: int) -> None:
        """`left` pieces of a length, each where least stays free; new sequences take as many as they hold."""
        while left:
            k = bisect.bisect_left(self.filled, length)
            if k == len(self.filled):
                each = self.capacity // length
                for count, fill in ((left // each, each), (min(1, left % each), left % each)):
                    held = None
                    for _ in range(fill):
                        held = (held, length)
                    self.put(self.capacity - fill * length, count, held)
                return
            free = self.filled[k]
            count, held = self.by_free[free].pop()
            if not self.by_free[free]:
                self.filled.pop(k)
            now = min(count, left)
            left -= now
            self.put(free, count - now, held)
            self.put(free - length, now, (held, length))

    def sequences(self) -> int:
        return sum(count for own in self.by_free for count, _ in own)

    def refitted(self, small: int) -> Rooms:
        """Sequences that are not full, or hold a piece of `small` or less, are dissolved; their pieces, longest first, are fitted anew."""
        out, loose = Rooms(self.capacity), Counter()
        for free, own in enumerate(self.by_free):
            for count, held in own:
                lengths = []
                rest = held
                while rest:
                    rest, length = rest
                    lengths.append(length)
                if free or min(lengths) <= small:
                    for length in lengths:
                        loose[length] += count
                else:
                    out.put(free, count, held)
        for length in sorted(loose, reverse=True):
            out.fit(length, loose[length])
        return out


class Plan:
    """Where the o-th piece of each length goes: slots are (length, first ordinal, count, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, large: float = 1 / 8):
        rooms = Rooms(capacity)
        cut = int(capacity * large)
        self._large(rooms, [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n > cut and histogram[n]], groups)
        for length in sorted((n for n in histogram if n <= cut), reverse=True):
            rooms.fit(length, histogram[length])
        # Rounding up left room where no small piece was left to fill it: those sequences are refitted with their actual lengths, and
        # with them more and more of those that hold the small pieces.
        bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
        small = 0
        while rooms.sequences() > bound and small <= 2 * capacity:
            again = rooms.refitted(small)
            if again.sequences() < rooms.sequences():
                rooms = again
            small = 2 * small or 1
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.taken = dict.fromkeys(histogram, 0)
        self.sequences = 0
        for own in rooms.by_free:
            for count, held in own:
                lengths = []
                while held:
                    held, length = held
                    lengths.append(length)
                offset = 0
                for length in reversed(lengths):
                    self.slots.append((length, self.taken[length], count, self.sequences, offset))
                    self.taken[length] += count
                    offset += length
                self.sequences += count

    @staticmethod
    def _large(rooms: Rooms, big: list[tuple[int, int]], groups: int) -> None:
        """Puts sequences with the large pieces into rooms."""
        total = sum(c for _, c in big)
        if not total:
            return
        each = -(-total // groups)
        sizes: list[int] = []
        members: list[list[list[int]]] = []  # of each group: [length, count], longest first
        room = 0
        for length, count in big:
            while count:
                if not room:
                    # Groups that would round up to one size are one group.
                    if not sizes or sizes[-1] != length:
                        sizes.append(length)
                        members.append([])
                    room = each
                now = min(count, room)
                members[-1].append([length, now])
                count -= now
                room -= now
        demand = [sum(c for _, c in m) for m in members]
        for column, times in configurations(sizes, demand, rooms.capacity):
            opened: list[tuple[int, int, tuple | None]] = [(times, 0, None)]
            for g, k in enumerate(column):
                for _ in range(k):
                    # The actual pieces, longest first, take this place in all sequences of the configuration.
                    parts = []
                    for count, used, held in opened:
                        while count:
                            length, have = members[g][0]
                            now = min(count, have)
                            parts.append((now, used + length, (held, length)))
                            count -= now
                            if now == have:
                                members[g].pop(0)
                            else:
                                members[g][0][1] -= now
                    opened = parts
            for count, used, held in opened:
                rooms.put(rooms.capacity - used, count, held)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length << 44 | first ordinal), first sequences and offsets."""
        a = np.array(self.slots, np.int64).reshape(-1, 5)
        keys = (a[:, 0] << 44) | a[:, 1]
        order = np.argsort(keys)
        return keys[order], a[order, 3], a[order, 4]


def with_ordinals(pieces: DataFrame, per_part: int = 200_000) -> DataFrame:
    """Adds `ordinal`, from 0 without gaps within each length. A length with many pieces is spread over several parts."""
    parts = max(8, pieces.count() // per_part)
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")))
    return numbered.join(offsets, ["length", "_part"]).withColumn("ordinal", F.col("_before") + F.col("_k") - 1).drop("_part", "_before", "_k")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 64) -> DataFrame:
    """Adds sequence_id and offset to `pieces` (length between 1 and capacity, doc_id, piece, start, ids_crc32). Nothing is lost.

    Repeated rows and null ids are pieces like any other; an empty table gives an empty result.
    """
    ship(pieces.sparkSession)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    keys, firsts, offsets = Plan(histogram, capacity, groups).table()

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, ordinal):  # type: ignore[no-untyped-def]
        import pandas as pd

        key = (length.to_numpy(np.int64) << 44) | ordinal.to_numpy(np.int64)
        k = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": firsts[k] + key - keys[k], "offset": offsets[k]})

    out = with_ordinals(pieces).withColumn("_place", place("length", "ordinal"))
    return out.select(*pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eot: int = EOT, keep_ids: bool = False) -> DataFrame:
    """Tokenizes `docs` (doc_id, text) and packs the pieces; the pieces are written once, so no text is encoded twice.

    Null or empty text is one piece, the end id. Rows with null or repeated ids are rows like any other, each with its own pieces;
    texts of any length are cut into pieces of `capacity` ids; other columns are left out; an empty table gives an empty result.
    """
    return pack_pieces(stored(tokenized_pieces(docs, tokenizer_path, capacity, eot, keep_ids), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens; nulls and repeats as in pack_documents."""
    import public_tokenizers

    out = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
