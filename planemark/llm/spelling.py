"""Spelling variant grouping: Aho-Corasick halves. Of two words that differ by one code point one half of the first stands whole in the
second, at its start or its end. Automata, a shard each, hold the words' halves; all words are scanned with them, hits are checked for
their place and for lengths, and the distance is verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, parts, read, ship, stored

#: Runs of a-z and U+00C0 to U+00FF in UTF-8, A-Z being lower-cased before.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One of so many distinct runs of a document, by its hash, loses a code point.
DAMAGE = 199
#: Words that a shard's automaton holds halves of, on average.
SHARD_WORDS = 10_000
#: A half that more words begin or end with is hot: they meet by what is left of them without one code point, not each with each.
HOT = 1000
#: Pairs that are verified at once.
PAIRS = 1 << 19
#: Distinct runs that a task counts before it hands them on.
COUNTED = 400_000


def damaged(word: bytes, crc: int) -> bytes:
    """The run without one code point, if 199 divides the hash."""
    if crc % DAMAGE:
        return word
    text = word.decode()
    at = crc % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of `docs` (doc_id, text): words with enough code points and occurrences in all texts.

    A word is a maximal run of letters, A-Z in lower case; where 199 divides the crc32 of "<doc_id>:<run>" it lacks the code point at
    crc32 modulo its length. Null text has no words; a null id is like an empty one; rows count as often as they stand there; other
    columns do no harm; an empty table has no words. Runs of a text of any length are counted in one pass.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in total if len(w) >= min_chars and len(w) - w.count(b"\xc3") >= min_chars]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

        for some, data, ends in parts(batches):
            for i, doc_id in enumerate(some.column("doc_id").to_pylist()):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for w, n in Counter(RUN.findall(data[ends[i] : ends[i + 1]].tobytes().lower())).items():
                    total[damaged(w, zlib.crc32(w, start))] += n
            if len(total) > COUNTED:
                yield out()
                total.clear()
        yield out()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _half(word: Column, end: bool, length: Column) -> Column:
    """The first half of a word of this length, or the rest."""
    first = F.floor(length / 2).cast("int")
    return F.substring(word, first + 1, length) if end else F.substring(word, F.lit(1), first)


def _keys(words: DataFrame) -> DataFrame:
    """Words with each half they have (own) and each part at their ends that is a half of a word they may be near to: (end, half, own,
    word, n). A word of one code point less or more has halves of at most one code point less or more."""
    length = F.char_length("word")
    first = [F.floor((length + d) / 2).cast("int") for d in (-1, 0, 1)]
    last = [length + d - F.floor((length + d) / 2).cast("int") for d in (-1, 0, 1)]
    starts = F.transform(F.array_distinct(F.array(*first)), lambda k: F.struct(F.lit(False).alias("end"), F.substring(F.col("word"), F.lit(1), k).alias("half"), (k == first[1]).alias("own")))
    ends = F.transform(F.array_distinct(F.array(*last)), lambda k: F.struct(F.lit(True).alias("end"), F.substring(F.col("word"), length - k + 1, k).alias("half"), (k == last[1]).alias("own")))
    return words.select(F.inline(F.concat(starts, ends)), "word", "n")


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """One row of bytes a word (its code points are below 256), filled up with zeros on one side."""
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        raw = np.frombuffer(w.encode("latin-1"), np.uint8)
        out[i, width - len(raw) :] = raw if right else 0
        if not right:
            out[i, : len(raw)] = raw
    return out


def _one_apart(left: np.ndarray, right: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs a, b of rows differ by exactly one inserted, deleted or replaced code point: what they share from the start and
    from the end covers all but one of the longer. left, right: the words filled up on the right and on the left; lengths differ by 1
    at most."""
    width = left.shape[1]
    other = left[a] != left[b]
    same_start = np.where(other.any(1), other.argmax(1), width)
    other = right[a][:, ::-1] != right[b][:, ::-1]
    same_end = np.where(other.any(1), other.argmax(1), width)
    long = np.maximum(size[a], size[b])
    return (same_start < long) & (np.minimum(same_start, long) + np.minimum(same_end, long) >= long - 1)


def near_in_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (end, half, own, word, n) of one shard: for each word how many near words its halves here give, and the best of them.

    A near word that both its halves would give counts by its first one alone.
    """
    import ahocorasick

    words = list(dict.fromkeys(rows["word"]))
    number = {w: i for i, w in enumerate(words)}
    counts = np.zeros(len(words), np.int64)
    at = rows["word"].map(number).to_numpy()
    counts[at] = rows["n"].to_numpy()
    # A pattern for each half, which both ends may share.
    owners: dict[str, dict[bool, list[int]]] = {}
    for end, half, own, i in zip(rows["end"], rows["half"], rows["own"], at, strict=True):
        if own:
            owners.setdefault(half, {}).setdefault(bool(end), []).append(int(i))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if owners:
        automaton = ahocorasick.Automaton()
        sets = []
        for half, of_ends in owners.items():
            automaton.add_word(half, len(sets))
            sets.append((len(half), {end: np.array(own) for end, own in of_ends.items()}))
        automaton.make_automaton()
        size = np.array([len(w) for w in words])
        narrow = int(min(size.max(), 40))
        fitting = [w if len(w) <= narrow else "" for w in words]
        left, right = _matrix(fitting, narrow, False), _matrix(fitting, narrow, True)
        half_of = size // 2
        asked, owning, by_end, pending = [], [], [], 0

        def verify() -> None:
            nonlocal asked, owning, by_end, pending
            if not asked:
                return
            a = np.repeat(np.array(asked), [len(o) for o in owning])
            b, e = np.concatenate(owning), np.repeat(np.array(by_end), [len(o) for o in owning])
            asked, owning, by_end, pending = [], [], [], 0
            keep = np.abs(size[a] - size[b]) <= 1
            a, b, e = a[keep], b[keep], e[keep]
            wide = (size[a] > narrow) | (size[b] > narrow)
            good = np.zeros(len(a), bool)
            good[~wide] = _one_apart(left, right, size, a[~wide], b[~wide])
            for k in np.flatnonzero(wide):
                good[k] = one_apart(words[a[k]], words[b[k]])
            for k in np.flatnonzero(good & e):
                good[k] = not words[a[k]].startswith(words[b[k]][: half_of[b[k]]])
            found.append((a[good], b[good]))

        for i, w in enumerate(words):
            for to, k in automaton.iter(w):
                length, of_ends = sets[k]
                for end, own in of_ends.items():
                    if to == (len(w) - 1 if end else length - 1):
                        asked.append(i)
                        owning.append(own)
                        by_end.append(end)
                        pending += len(own)
            if pending > PAIRS:
                verify()
        verify()
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    pairs = pd.DataFrame({"i": a, "n": counts[b], "word": [words[k] for k in b]})
    best = pairs.sort_values(["i", "n", "word"], ascending=[True, False, True]).groupby("i", sort=False)
    out = best.first().reset_index()
    return pd.DataFrame({"word": [words[k] for k in out["i"]], "n_near": best.size().to_numpy(), "best_n": out["n"].to_numpy(), "best": out["word"].to_numpy()}).astype({"n_near": "int64", "best_n": "int64", "word": "object", "best": "object"})


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _near_by_gaps(keys: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) from rows of hot halves alone: pairs meet by the half and the rest of the word without one code point,
    so that a group holds words which differ in one place, as many as there are letters at most, or a word and those one longer."""
    rest = F.when(F.col("end"), F.substring(F.col("word"), F.lit(1), F.char_length("word") - F.char_length("half"))).otherwise(F.substring(F.col("word"), F.char_length("half") + 1, F.char_length("word")))
    rows = keys.withColumn("rest", rest)
    without = F.transform(F.sequence(F.lit(1), F.char_length("rest")), lambda i: F.struct(i.alias("at"), F.concat(F.substring(F.col("rest"), F.lit(1), i - 1), F.substring(F.col("rest"), i + 1, F.char_length("rest"))).alias("left")))
    gaps = rows.where(F.char_length("rest") > 0).select("end", "half", "own", "word", "n", F.inline(without))
    shorter = rows.select("end", "half", "own", "word", "n", F.col("rest").alias("left"))
    longer = gaps.drop("at").distinct()
    tag = lambda df, t: df.select("end", "half", *([] if "at" not in df.columns else ["at"]), "left", *(F.col(c).alias(f"{c}_{t}") for c in ("own", "word", "n")))
    place = ["end", "half", "left"]
    pair = ["end", "word_a", "n_a", "own_a", "word_b", "n_b", "own_b"]
    replaced = tag(gaps, "a").join(tag(gaps, "b"), [*place, "at"]).where("word_a <> word_b").select(*pair)
    one = tag(longer, "a").join(tag(shorter, "b"), place).select(*pair)
    other = one.select("end", F.col("word_b").alias("word_a"), F.col("n_b").alias("n_a"), F.col("own_b").alias("own_a"), F.col("word_a").alias("word_b"), F.col("n_a").alias("n_b"), F.col("own_a").alias("own_b"))
    found = replaced.unionByName(one).unionByName(other).where("own_b")
    # As in the shards: what the first half gives the last one does not give again.
    first = _half(F.col("word_b"), False, F.char_length("word_b"))
    found = found.where(~F.col("end") | ~F.startswith(F.col("word_a"), first)).select("word_a", "word_b", "n_b")
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("word_b").alias("w")))
    return found.groupBy(F.col("word_a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


#: Up to so many hot halves are broadcast, each of some 20 bytes; more meet the words in a shuffle.
BROADCAST_HALVES = 200_000


def near_words(words: DataFrame, hot: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best) of `words` (word, n; distinct, code points below 256): how many of them differ by exactly one code
    point, and among those the one of largest n, then the smallest. Words without any are absent.

    Halves are dealt to automata by their hash, one for each SHARD_WORDS words. The words of halves with more than `hot` of them are
    compared by gaps instead: any number of words may share one.
    """
    hot = HOT if hot is None else hot
    ship(words.sparkSession)
    keys = stored(_keys(words), "halves")
    crowded = stored(keys.groupBy("end", "half").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot).select("end", "half"), "hot-halves")
    n_hot = crowded.count()
    side = F.broadcast(crowded) if n_hot <= BROADCAST_HALVES else crowded
    shards = max(1, -(-words.count() // SHARD_WORDS))
    cool = keys.join(side, ["end", "half"], "left_anti").withColumn("shard", F.pmod(F.xxhash64("half"), F.lit(shards)).cast("int"))
    found = cool.groupBy("shard").applyInPandas(lambda rows: near_in_shard(rows), "word string, n_near long, best_n long, best string")
    if n_hot:
        found = found.unionByName(_near_by_gaps(keys.join(side, ["end", "half"], "left_semi")))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    out = stored(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best")), "near-words")
    discard(keys, crowded)
    return out


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds `root` to `forms` (word, form, ..): where following forms from word ends; the word itself if its form is null.

    In each round a word's guess becomes the guess of its guess, so rounds grow with the logarithm of the longest chain.
    """
    now = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        moved = not step.where("moved").isEmpty()
        now = step
        if not moved:
            return forms.join(now.select("word", "root"), "word")


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of `words` (word, n), one row a word.

    form: the near word of largest n, ties to the smallest, if it has `times` the word's n or more; else null. An empty table stays empty.
    """
    words = stored(words, "words")
    near = near_words(words)
    is_form = F.col("best_n") >= times * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    out = stored(out, "forms")
    discard(near, words)
    return with_roots(out)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root; nulls and repeats as in word_counts."""
    return spelling_variants(word_counts(read(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
