"""N-gram Jaccard join by token-combination prefixes: prefixes are extended, single tokens are indexed for rare token classes and
combinations of two for frequent ones, and candidates are verified.

A document is its set of distinct word shingles (the tokens). Tokens stand in one global order, by the number of documents that
have them and then by hash. Let two sets of at most n tokens be similar: at most n - o of the tokens of either are not shared, o
being the least overlap that the threshold allows. So of the first n - o + 1 + m tokens of both, m + 1 at least are shared; if one
of these is rare, the index of single tokens finds the pair. Else, as a hash deals the tokens into m classes, two of them are of
one class, and the index of pairs of frequent tokens of a class finds it. m grows with n, so that a class has a bounded number of
tokens and the index grows with the length of the texts, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, discard, mix, parts, range_hashes, ranged, read, rolling, settled, ship, stored, within, words
from .components import components
from .packed import FLUSH, bits_for, pack, text_bytes, unpack, _arrow

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit hash of each distinct shingle, sorted by both."""
    data = LOWER[data]
    total = range_hashes(data)
    starts, ends, firsts = words(data, offsets)
    hashes = mix(ranged(total, starts, ends))
    at = within(firsts, size)
    keys = rolling(hashes, size)[at] if len(at) else np.zeros(0, U)
    rows = np.searchsorted(firsts, at, "right") - 1
    counts = np.diff(firsts)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows = np.append(rows, short)
            keys = np.append(keys, rolling(hashes, n, seed=n)[firsts[short]])
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))) if len(rows) else np.zeros(0, bool)
    return rows[new], keys[new]


LOW = 48
KINDS = "bucket int, kind int, payload binary"
#: A gathering of documents is flushed at so many of them at least, as entries name them by 16 bits.
DOCS = 60_000


def _kinded(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind] * b.num_rows, pa.int32()), b.column(1)], ["bucket", "kind", "payload"])


def _one_row(bucket: int, headers: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A packed value whose headers are short and whose entries belong to no document in particular."""
    payload = pack(headers, np.full(len(headers[0]), 0), columns)
    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], ["bucket", "payload"])


def _pack_sets(docs: DataFrame, size: int, bits: int, shards: int) -> DataFrame:
    """The tokens (kind 0) by the upper bits of their hashes, with 48 further bits and the number of their set in its gathering; and
    the documents of each gathering (kind 1), by the gathering's shard.

    An entry takes eight bytes whatever the number of buckets. Equal sets of a gathering are sent once. A gathering is named by
    the partition and its number there, so docs must give the same rows in the same order when a task runs again: as from settled().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held: list[tuple] = []
        n_docs = n_keys = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal name, held, n_docs, n_keys
            if held:
                h1, h2, n, ids, null = (np.concatenate(x) for x in list(zip(*held, strict=True))[:5])
                lengths = n.astype(np.int64)
                keys = np.concatenate([x[5] for x in held])
                both = np.rec.fromarrays([h1, h2])
                _, first, number = np.unique(both, return_index=True, return_inverse=True)
                own = np.repeat(np.arange(len(h1)), lengths)
                sent = (np.bincount(first, minlength=len(h1)) > 0)[own]
                keys, sets = keys[sent], number[own[sent]].astype(np.uint16)
                bucket = (keys >> U(64 - bits)).astype(np.int32)
                order = np.lexsort((sets, bucket))
                bucket, keys, sets = bucket[order], keys[order], sets[order]
                cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
                this = np.array([name], U)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    cols = [(keys[a:b] & U(0xFFFFFFFF)).astype(np.uint32), ((keys[a:b] >> U(32)) & U(0xFFFF)).astype(np.uint16), sets[a:b]]
                    yield from _kinded(_one_row(int(bucket[a]), [this], cols), 0)
                yield from _kinded(_one_row(int(mix(this)[0] % U(shards)), [h1, h2, n, ids, null, np.full(len(h1), name, U), number.astype(U)], [np.zeros(0, np.uint16)]), 1)
            name += 1
            held, n_docs, n_keys = [], 0, 0

        for batch, data, offsets in parts(batches):
            rows, keys = shingle_sets(data, offsets, size)
            n = batch.num_rows
            edges = np.searchsorted(rows, np.arange(n + 1))
            sums = []
            for codes in (mix(keys ^ U(1)), mix(keys ^ U(2))):
                all_ = np.concatenate((np.zeros(1, U), np.cumsum(codes, dtype=U)))
                sums.append(all_[edges[1:]] - all_[edges[:-1]])
            ids = batch.column("doc_id")
            doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False)).astype(U)
            for a in range(0, n, DOCS):
                if n_docs and (n_docs + min(n - a, DOCS) > DOCS or n_keys >= FLUSH):
                    yield from flush()
                c = slice(a, a + DOCS)
                held.append((sums[0][c], sums[1][c], np.diff(edges)[c].astype(U), doc_ids[c], null[c], keys[edges[a] : edges[min(n, a + DOCS)]]))
                n_docs += len(doc_ids[c])
                n_keys += len(held[-1][5])
        yield from flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, KINDS)


def _shared(packed: DataFrame, bits: int, shards: int) -> DataFrame:
    """Tokens that two sets have, with the number of sets that sent them, by the shard of their gathering. Documents pass through:
    their bucket is the shard already."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = U(key[0].as_py())
        names, lows, sets, out = [], [], [], []
        for b in table.to_batches():
            kind = b.column("kind").to_numpy()
            if kind.any():
                out.append(b.filter(pa.array(kind == 1)))
        for kind, p in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            if kind:
                continue
            (name,), _, (low, mid, own) = unpack([p.as_py()])
            names.append(np.full(len(low), name[0], U))
            lows.append((mid.astype(U) << U(32)) | low.astype(U))
            sets.append(own.astype(np.uint16))
        if not lows:
            return pa.Table.from_batches(out, schema=_arrow(KINDS))
        name, low, own = np.concatenate(names), np.concatenate(lows), np.concatenate(sets)
        del names, lows, sets
        order = np.argsort(low, kind="stable")
        new = np.concatenate(([True], low[order][1:] != low[order][:-1]))
        begins = np.flatnonzero(new)
        df = np.diff(np.append(begins, len(low)))
        several = np.repeat(df > 1, df)
        place, df = order[several], np.repeat(df, df)[several].astype(np.uint32)
        back = np.argsort(place)
        place, df = place[back], df[back]
        name, own = name[place], own[place]
        token = low[place] ^ (bucket << U(LOW) if bits <= 64 - LOW else mix(np.full(1, bucket, U))[0])
        cuts = np.append(np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))), len(name)) if len(name) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            this = name[a : a + 1]
            out += _kinded(_one_row(int(mix(this)[0] % U(shards)), [this], [token[a:b], df[a:b], own[a:b]]), 0)
        return pa.Table.from_batches(out, schema=_arrow(KINDS))

    return packed.groupBy("bucket").applyInArrow(run, KINDS)


SETS = "doc_id long, h1 long, h2 long, n_shingles long, n_shared long, n_rare long, mass long, tokens array<long>"


def _gathered(shared: DataFrame, percent: int, rare: int) -> DataFrame:
    """A row for each document. The first of a set in its gathering also has its shared tokens in the global order, if they can be
    enough.

    mass: the mean number of sets that have a token of the set; the source of many near copies has the greatest.
    """

    def run(table: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(8)]
        entries, homes = {}, []
        for kind, p in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            headers, _, columns = unpack([p.as_py()])
            if kind:
                homes.append(headers)
            else:
                entries.setdefault(int(headers[0][0]), []).append(columns)
        for h1, h2, n, ids, null, names, number in homes:
            given = entries.get(int(names[0]), [])
            keys, df, sets = (np.concatenate([c[k] for c in given]) if given else np.zeros(0, U) for k in range(3))
            order = np.lexsort((keys, df, sets))
            keys, df, sets = keys[order].view(np.int64), df[order].astype(np.int64), sets[order]
            edges = np.searchsorted(sets, np.arange(int(number.max()) + 2))
            own = np.lexsort((ids, number))
            first = np.concatenate(([True], number[own][1:] != number[own][:-1]))
            at = number[own].astype(np.int64)
            a, b, size = edges[at], edges[at + 1], n[own].astype(np.int64)
            enough = first & (size > 0) & (100 * (b - a) >= percent * size)
            all_df = np.concatenate(([0], np.cumsum(df)))
            made = [
                pa.array(ids[own].view(np.int64), mask=null[own] == 1), pa.array(h1[own].view(np.int64)), pa.array(h2[own].view(np.int64)), pa.array(size), pa.array(b - a),
                pa.array([int(np.searchsorted(df[x:y], rare, "right")) if e else 0 for x, y, e in zip(a, b, enough, strict=True)], pa.int64()),
                pa.array((all_df[b] - all_df[a]) // np.maximum(size, 1)), pa.array([keys[x:y] if e else None for x, y, e in zip(a, b, enough, strict=True)], pa.list_(pa.int64())),
            ]
            for c, x in zip(cols, made, strict=True):
                c.append(x)
        schema = _arrow(SETS)
        return pa.Table.from_arrays([pa.chunked_array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return shared.groupBy("bucket").applyInArrow(run, SETS)


#: Up to so many sets that pairs name are broadcast to fetch their tokens; more meet in a shuffle.
FEW = 100_000


def _only(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of ids (id, distinct): how they are fetched hangs on their number, the result does not."""
    return reps.join(F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids, "id", "left_semi")


def _verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar. Tokens that no other set has count in the sizes alone."""
    pairs = stored(pairs, "pairs")
    reps = _only(reps, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _several(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys under which sets of two components or more stand, with the number of their rows and the set of greatest mass."""
    return rows.groupBy(*key).agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.max(F.struct("weight", "shuffled", "id", "comp")).alias("_top"), F.count(F.lit(1)).alias("_rows")).where("_low <> _high").drop("_low", "_high")


def _labelled(index: DataFrame, labels: DataFrame | None, turn: int, *more: str) -> DataFrame:
    index = index.select(*INDEX, *more)
    out = index.withColumn("comp", F.col("id")) if labels is None else index.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    # In the first turn the set of greatest mass is the centre of a key, later any.
    return out.withColumn("shuffled", F.xxhash64(F.lit(turn), "id")).withColumn("weight", F.col("mass") if turn == 0 else F.lit(0))


#: Words of 64 bits in a set's sketch.
WORDS = 4


def _shape() -> Column:
    """Of a set (n, n_shared, tokens): alone, the number of its tokens that no other set has; shared, that of the rest; and w0 to w3, a
    sketch: the parity of the shared tokens' number in each of 256 classes."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    of = lambda k: lambda s, t: F.when(F.shiftright(t, 6).bitwiseAND(F.lit(WORDS - 1).cast("long")) == k, s.bitwiseXOR(bit(t))).otherwise(s)
    sketch = [x for k in range(WORDS) for x in (F.lit(f"w{k}"), F.aggregate("tokens", F.lit(0).cast("long"), of(k)))]
    return F.named_struct(F.lit("alone"), F.col("n") - F.col("n_shared"), F.lit("shared"), F.col("n_shared"), *sketch)


def _slack(percent: int) -> Column:
    """Two sets can only be similar if the sum of theirs is not negative."""
    return (100 - percent) * F.col("n") - (100 + percent) * F.col("shape.alone")


def _may_link(percent: int) -> Column:
    """False only for pairs (n, shape; n_b, shape_b) that are not similar.

    Sets are similar exactly if (100 + percent) times the tokens that only one has are (100 - percent) times all at most. Tokens that no
    other set has are such, and at least as many of the others as the sketches differ in, since each changes one bit.
    """
    differ = sum((F.bit_count(F.col(f"shape.w{k}").bitwiseXOR(F.col(f"shape_b.w{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("shape.w0").bitwiseXOR(F.col("shape_b.w0"))))
    apart = F.greatest(differ.cast("long"), F.abs(F.col("shape.shared") - F.col("shape_b.shared")))
    return (100 + percent) * (F.col("shape.alone") + F.col("shape_b.alone") + apart) <= (100 - percent) * (F.col("n") + F.col("n_b"))


INDEX = ("id", "n", "mass", "token", "rare")
OWN = ("id", "n", "comp", "weight", "shuffled")
MET = (*OWN, "shape")
#: Keys with more rows than this are compared by their sets' differences from a centre, not pair by pair.
HOT = 64


def _differences(hot: DataFrame, reps: DataFrame, percent: int, kept: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """For sets (id, n, comp, weight, shuffled, shape) that are to be compared with others of one centre c: certain links (a, b), and the
    keys k under which the other linked pairs meet.

    Let X be the symmetric difference of a set and the centre, u the number of tokens that no other set has, and
    S = (100 + percent) (u + |X|) - (100 - percent) n. Two sets are similar exactly if their X share (S + S') / (2 (100 + percent))
    tokens or more. Where the sum is 0 or less for a set and the one of the least S, both are linked, and so are all such sets
    with one another. All other pairs must share tokens of X, so prefixes of X in the order of the tokens' rarity in the group find
    them; sets whose X is too short for any link drop out. The centre has no X, so for it the first case decides, and the least S'
    that others have to reckon with is that of the rest: with the centre's, prefixes were longer and turns added rows.
    """
    side = lambda x: reps.select(F.col("id").alias(x), F.col("tokens").alias(f"_{x}"))
    own = hot.join(reps.select("id", "n_shared", "tokens"), "id").join(side("c"), "c")
    own = own.withColumn("x", F.concat(F.array_except("tokens", "_c"), F.array_except("_c", "tokens"))).withColumn("s", (100 + percent) * (F.col("n") - F.col("n_shared") + F.size("x")) - (100 - percent) * F.col("n"))
    own = stored(own.drop("tokens", "_c"), "differences")
    kept.append(own)
    least = own.groupBy("c").agg(F.min(F.struct("s", "id", "comp")).alias("m"), F.min(F.when(F.col("id") != F.col("c"), F.col("s"))).alias("rest"))
    own = own.join(least, "c").withColumn("near", (F.col("s") + F.col("m.s") <= 0) | (F.col("id") == F.col("m.id")))
    certain = own.where(F.col("near") & (F.col("id") != F.col("m.id")) & (F.col("s") + F.col("m.s") <= 0)).select(F.least("id", F.col("m.id")).alias("a"), F.greatest("id", F.col("m.id")).alias("b"))
    needed = F.ceil(F.when(F.col("near"), F.col("s") - F.col("m.s") + 1).otherwise(F.col("s") + F.col("rest")) / (2.0 * (100 + percent)))
    left = own.withColumn("long", F.size("x") - F.greatest(needed, F.lit(1)) + 1).where("long > 0").withColumn("comp", F.when(F.col("near"), F.col("m.comp")).otherwise(F.col("comp")))
    each = left.select("c", *MET, "long", F.explode("x").alias("e"))
    ranked = each.join(each.groupBy("c", "e").agg(F.count(F.lit(1)).alias("df")), ["c", "e"])
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("c", "id").orderBy("df", "e"))).where("at <= long AND df > 1")
    return certain, ranked.select(F.xxhash64("c", "e").alias("k"), *MET)


def _met(keyed: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of different components that may be similar, among all that stand under one key k.

    Keys of many rows are replaced by those of the sets' differences from their centre, until none is left: the centre itself drops
    out each time, and only sets that differ from it alike meet again. Also the tables that the pairs are read from.
    """
    pairs, kept = None, []
    while True:
        best = keyed.groupBy("k").agg(F.max(_slack(percent)).alias("_best"))
        keyed = stored(keyed.join(_several(keyed, ["k"]).join(best, "k"), "k").where(_slack(percent) + F.col("_best") >= 0).drop("_best"), "keyed")
        kept.append(keyed)
        cold = keyed.where(F.col("_rows") <= HOT)
        other = cold.select("k", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), F.col("shape").alias("shape_b"))
        some = cold.join(other, "k").where((F.col("id") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & _may_link(percent)).select(F.col("id").alias("a"), "b").distinct()
        pairs = some if pairs is None else pairs.unionByName(some)
        hot = keyed.where(F.col("_rows") > HOT)
        if hot.isEmpty():
            return pairs.distinct(), kept
        hot = hot.groupBy(F.col("_top.id").alias("c"), "id").agg(*(F.min(x).alias(x) for x in MET[1:]))
        certain, keyed = _differences(hot, reps, percent, kept)
        pairs = pairs.unionByName(certain)


def _singles(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.where("rare").select(*columns, F.xxhash64("token", "token").alias("k"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """Rows of sets under keys k, which are single rare tokens, and two frequent ones that are neighbours in the order of the set's."""
    lists = rows.where("NOT rare").groupBy("id").agg(*(F.first(x).alias(x) for x in OWN[1:]), F.sort_array(F.collect_set("token")).alias("ts"))
    beside = F.arrays_zip(F.slice("ts", F.lit(1), F.size("ts") - 1).alias("t"), F.slice("ts", 2, F.size("ts")).alias("u"))
    pairs = lists.where(F.size("ts") > 1).select(*OWN, F.explode(beside).alias("c")).select(*OWN, F.xxhash64("c.t", "c.u").alias("k"))
    return _singles(rows, OWN).unionByName(pairs)


def _prefix(percent: int) -> Column:
    """The first n - o + 2 tokens, without those that no other set has: these come first and are not in the arrays."""
    return F.greatest(F.col("n_shared") - F.ceil(F.col("n") * percent / 100) + 2, F.lit(0)).cast("int")


def _classes(n: str, percent: int) -> Column:
    """Classes of tokens in sets of n: the power of two next below a sixteenth of the tokens that similar sets need not share. A class
    has some 17 to 34 of a prefix's tokens then: fewer would make the index shorter, but prefixes longer and candidates more.

    The numbers of two similar sets are equal or one is twice the other, as percent is over 50.
    """
    return F.expr(f"CAST(shiftleft(1L, length(bin(greatest(1L, CAST({n} AS BIGINT) * {100 - percent} div 1600))) - 1) AS INT)")


CLASSED = ("coarse", "fine", "near", "shape")


def _longer(reps: DataFrame, percent: int) -> DataFrame:
    """The index of extended prefixes: a row for each of their tokens, with its class and its class among those of the largest similar
    set. near: in the prefix that the set's own number of classes needs.

    A set whose plain prefix is rare altogether shares a rare token of it with every similar set, and is not extended.
    """
    sets = reps.withColumn("own", _classes("n", percent)).withColumn("wide", _classes(f"(n * 100 div {percent})", percent)).withColumn("plain", _prefix(percent))
    many = F.when(F.col("n_rare") < F.col("plain"), F.col("plain") + F.col("wide") - 1).otherwise(F.col("plain"))
    rows = sets.select("id", "n", "mass", "n_rare", "own", "wide", "plain", _shape().alias("shape"), F.posexplode(F.slice("tokens", F.lit(1), many)).alias("at", "token"))
    of = lambda m: F.pmod(F.xxhash64("token"), m).cast("int")
    return rows.select("id", "n", "mass", "token", (F.col("at") < F.col("n_rare")).alias("rare"), of("own").alias("coarse"), of("wide").alias("fine"), (F.col("at") < F.col("plain") + F.col("own") - 1).alias("near"), "shape")


def _combined(rows: DataFrame) -> DataFrame:
    """Rows of sets under keys k: single rare tokens, and all twos of frequent tokens of one class, with the set's own number of classes
    or that of the largest similar set. Classes are a power of two, so the finer divide the coarser ones."""
    lists = rows.where("NOT rare").groupBy("id", "coarse").agg(*(F.first(x).alias(x) for x in MET[1:]), F.sort_array(F.collect_set(F.struct("token", "fine", "near"))).alias("ts"))
    fits = lambda t: lambda u: (t["near"] & u["near"]) | (t["fine"] == u["fine"])
    of_one = lambda t, i: F.transform(F.filter(F.slice("ts", i + 2, F.size("ts")), fits(t)), lambda u: F.xxhash64(t["token"], u["token"]))
    pairs = lists.where(F.size("ts") > 1).select(*MET, F.explode(F.flatten(F.transform("ts", of_one))).alias("k"))
    return _singles(rows, MET).unionByName(pairs)


def similar_sets(reps: DataFrame, percent: int, turns: int = 3) -> DataFrame | None:
    """(id, comp) for the sets (id, n, n_shared, n_rare, mass, tokens) that are linked with others.

    Links between sets of one component do not change the components, so candidates are sought between different ones only, and
    tokens under which one component stands leave the index. In each of some turns every set is verified against one centre of the
    keys that it stands under, and the components are found anew: one pair a set, which joins large groups of near copies. For what
    then still has a token in common with another component, prefixes are extended, the combinations of each class are indexed and
    all candidates verified.
    """
    index = stored(reps.select("id", "n", "mass", "n_rare", F.posexplode(F.slice("tokens", F.lit(1), _prefix(percent))).alias("at", "token")).select("id", "n", "mass", "token", (F.col("at") < F.col("n_rare")).alias("rare")), "prefixes")
    links, labels, kept = None, None, []
    for turn in range(turns + 1):
        rows = _labelled(index, labels, turn % turns)
        rows = stored(rows.join(_several(rows, ["token"]).select("token"), "token"), "open-prefixes")
        discard(index)
        if rows.isEmpty():
            return labels
        index = rows
        if turn < turns:
            keyed = _neighbours(rows)
            met = keyed.join(_several(keyed, ["k"]).select("k", "_top"), "k").where(F.col("comp") != F.col("_top.comp"))
            # Of the centres of a set's keys one is verified in this turn.
            pairs = met.groupBy("id").agg(F.max("_top").alias("_top")).select(F.least("id", F.col("_top.id")).alias("a"), F.greatest("id", F.col("_top.id")).alias("b")).distinct()
        else:
            ids = stored(rows.select("id").distinct(), "open")
            rows = _labelled(_longer(_only(reps, ids), percent), labels, 0, *CLASSED)
            rows = stored(rows.join(_several(rows, ["token"]).select("token"), "token"), "extended-prefixes")
            discard(index)
            pairs, kept = _met(_combined(rows), reps, percent)
        found = stored(_verified(pairs, reps, percent), "links")
        discard(*kept)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    return labels


def similarity_classes(docs: DataFrame, size: int = 5, percent: int = 80, rare: int = 32) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of `docs` (doc_id, text).

    Two rows are linked if their sets of `size`-word shingles (A-Z in lower case) have a Jaccard similarity of percent / 100 or
    more; component_id is the smallest doc_id that links reach, the row's own included. Fewer words than `size` are one shingle;
    rows without words have none and are linked with nothing. Rows with equal sets are linked however many there are. A null
    doc_id is smaller than none: its component_id is that of its links, or null. Repeated rows are linked with one another;
    extra columns are left out; an empty table gives an empty result. Very long texts: the index has a bounded number of rows a shingle,
    in arrays of one class of them; the shingles of one text are one array. Sets are compared by hashes of their shingles (48 bits and the
    bucket's). percent must be over 50: below, sets of one token may be similar to larger ones, and have no combination of two.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    ship(docs.sparkSession)
    docs = settled(docs.select("doc_id", "text"))
    n_bytes = text_bytes(docs)
    bits, shards = bits_for(n_bytes, 12 << 20), max(8, n_bytes // (16 << 20))
    sets = stored(_gathered(_shared(_pack_sets(docs, size, bits, shards), bits, shards), percent, rare), "sets")
    ident = F.struct("h1", "h2").alias("id")
    reps = stored(sets.where("tokens IS NOT NULL").dropDuplicates(["h1", "h2"]).select(ident, F.col("n_shingles").alias("n"), "n_shared", "n_rare", "mass", "tokens"), "representatives")
    labels = similar_sets(reps, percent)
    firsts = sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first")).select(ident, "first")
    if labels is not None:
        own = firsts.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        # A component of many sets is a hot key of this join, which adaptive execution splits.
        firsts = own.select("id", "comp").join(own.groupBy("comp").agg(F.min("first").alias("first")), "comp")
    firsts = firsts.select(F.col("id.h1").alias("h1"), F.col("id.h2").alias("h2"), "first")
    joined = sets.select("doc_id", "h1", "h2", "n_shingles").join(firsts, ["h1", "h2"], "left")
    # Stored, so that the sets, which have a number a token, need not stay for the result.
    out = stored(joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("first")).alias("component_id")), "classes")
    discard(sets, reps)
    return out


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of 3-word sets at a similarity of 0.9; nulls and repeats as in similarity_classes."""
    return similarity_classes(read(spark, sf_dir, "documents"), 3, 90)


OP4_SQL = """
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents
), words AS (SELECT rid, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
shingles AS MATERIALIZED (
  SELECT DISTINCT rid, said FROM (
    SELECT rid, n, pos, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS said FROM words
  ) WHERE pos + 2 <= greatest(n, 3)
), sizes AS MATERIALIZED (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
entries AS MATERIALIZED (SELECT s.rid, z.n, s.said FROM shingles s JOIN sizes z ON z.rid = s.rid),
common AS (
  SELECT a.rid AS x, b.rid AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS met
  FROM entries a JOIN entries b ON b.said = a.said AND b.rid <> a.rid AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n GROUP BY a.rid, b.rid
), links AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * met >= 90 * (nx + ny - met)),
reached AS (
  SELECT rid, rid AS other FROM docs UNION SELECT r.rid, l.y FROM reached r JOIN links l ON l.x = r.other
), least AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reached r JOIN docs d ON d.rid = r.other GROUP BY r.rid)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, c.component_id
FROM docs d JOIN least c ON c.rid = d.rid LEFT JOIN sizes z ON z.rid = d.rid
"""
