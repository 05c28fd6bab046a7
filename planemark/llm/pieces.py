"""SentencePiece encoding and decoding with seeded merge-dropout: each candidate merge is skipped by a keyed hash as the agenda is
processed, so segmentations vary with the seed and still decode to the same text."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, mix, read, ship, shipped

SPACE = "▁"
#: No piece has a space mark after another character, or a line end: these parts never merge with one another.
CHUNK = re.compile(f" *[^ \n{SPACE}]+|\n|{SPACE}| +")
#: Chunks of up to so many characters are merged side by side in arrays; longer ones, one by one, keep a heap. Both give the same.
SCANNED = 48
#: Upper ends of the lengths that are merged together.
WIDTHS = (3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48)
#: Characters of texts that are encoded together, and chunks that are merged together.
TOGETHER, ROWS = 1 << 19, 1 << 16
#: Decisions of a long chunk that are drawn at once.
DRAWN = 256
SPREAD = U(0x9E3779B97F4A7C15)


class Skips:
    """Which candidate merges of a text are skipped: a keyed hash of the text, the chunk's place in it and the candidate's turn."""

    def __init__(self, text: str, dropout: float, seed: int):
        self.limit = min(int(dropout * 2**64), 2**64 - 1)
        self.key = xxhash.xxh64_intdigest(text.encode(), seed % 2**64)

    def later(self, place: int, turn: int) -> bool:
        """One decision."""
        return bool(skipped(U(self.key), np.array([place], U), U(turn), self.limit)[0])

    def drawn(self, place: int) -> Iterator[bool]:
        """All decisions of one place, in order."""
        for at in itertools.count(0, DRAWN):
            yield from skipped(U(self.key), U(place), np.arange(at, at + DRAWN, dtype=U), self.limit).tolist()


def skipped(keys: U | np.ndarray, places: U | np.ndarray, turns: U | np.ndarray, limit: int) -> np.ndarray:
    """Decisions by text key, place and turn; any two of the three may be single values."""
    return mix((places << U(32) | turns) * SPREAD + keys) < U(limit)


class Pairs:
    """Which two symbols merge, into which symbol and how early: an open hash table in arrays."""

    def __init__(self, found: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(10, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        wanted = np.array([a << 24 | b for a, b in found], np.int64)
        self.ranks, self.made = (np.array([v[k] for v in found.values()] + [x], np.int32) for k, x in ((0, NEVER), (1, 0)))
        waiting, slot = np.arange(wanted.size), self._first(wanted)
        while waiting.size:
            free = self.keys[slot] < 0
            self.slots[slot[free]] = waiting[free]
            self.keys[slot[free]] = wanted[self.slots[slot[free]]]
            late = self.slots[slot] != waiting
            waiting, slot = waiting[late], slot[late] + 1 & (1 << self.bits) - 1

    def _first(self, wanted: np.ndarray) -> np.ndarray:
        return (wanted.astype(U) * SPREAD >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in ranks and made; the last place for pairs that do not merge."""
        wanted = left.astype(np.int64) << 24 | right
        slot = self._first(wanted)
        there = self.keys[slot]
        out = np.where(there == wanted, self.slots[slot], -1)
        waiting = np.flatnonzero((there != wanted) & (there >= 0))
        while waiting.size:
            slot[waiting] = slot[waiting] + 1 & (1 << self.bits) - 1
            there = self.keys[slot[waiting]]
            hit = there == wanted[waiting]
            out[waiting[hit]] = self.slots[slot[waiting[hit]]]
            waiting = waiting[~hit & (there >= 0)]
        return out


#: Order of a gap that does not merge; others are rank << 6 | place of the gap.
NEVER = np.int32(2**31 - 1)


class PieceModel:
    """A BPE model with byte fallback, an identity normalizer and a space in front of each text."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {names[i]: i for i in range(n) if not special[i]}
        self.order = {names[i]: -sp.get_score(i) for i in range(n) if not special[i]}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        #: What each id stands for; control ids for nothing.
        self.raw = [b"" if special[i] and not sp.is_byte(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        # Symbols are the pieces, then other characters that pieces hold, then one for all other characters.
        symbols = {p: k for k, p in enumerate(self.ids)}
        for c in sorted({c for p in self.ids for c in p} - symbols.keys()):
            symbols[c] = len(symbols)
        self.other = len(symbols)
        self.id_of = np.full(self.other + 1, -1, np.int64)
        self.id_of[: len(self.ids)] = list(self.ids.values())
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for c, k in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = k
        self.symbol_of[ord(" ")] = self.symbol_of[ord(SPACE)]
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int64)
        ranks = {x: k for k, x in enumerate(sorted(set(self.order.values())))}
        self.pairs = Pairs({(symbols[p[:k]], symbols[p[k:]]): (ranks[self.order[p]] << 6, symbols[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols})

    def _merge(self, sym: np.ndarray, places: np.ndarray, keys: np.ndarray, limit: int) -> None:
        """Merges the chunks in the columns of sym in place, of which a merged part's later places become -1. The row below the last is
        spare. In turn t each column's first gap in order is decided on; one that was skipped comes back when a side of it merges."""
        width = len(sym) - 1
        after = np.repeat(np.arange(1, width + 2, dtype=np.int32)[:, None], sym.shape[1], axis=1)
        before = after - np.int32(2)
        agenda, made = np.full(sym.shape, NEVER), np.zeros(sym.shape, np.int32)
        for k in range(width - 1):
            at = self.pairs(sym[k], sym[k + 1])
            agenda[k] = np.where(at < 0, NEVER, self.pairs.ranks[at] | k)
            made[k] = self.pairs.made[at]
        cols = np.arange(sym.shape[1])
        for turn in itertools.count():
            least = agenda.min(axis=0)
            row = np.flatnonzero(least != NEVER)
            if not row.size:
                return
            if 2 * row.size < cols.size:
                agenda, cols, least = agenda[:, row], cols[row], least[row]
                row = np.arange(cols.size)
            gap = least[row] & 63
            agenda[gap, row] = NEVER
            if limit:
                stay = ~skipped(keys[cols[row]], places[cols[row]], U(turn), limit)
                row, gap = row[stay], gap[stay]
            col = cols[row]
            right = after[gap, col]
            far, near, new = after[right, col], before[gap, col], made[gap, col]
            agenda[right, row] = NEVER
            sym[gap, col], sym[right, col] = new, -1
            after[gap, col], before[far, col] = far, gap
            # The spare row is of no known symbol: a gap that leads there, or comes from there, never merges.
            at = self.pairs(np.concatenate([new, sym[near, col]]), np.concatenate([sym[far, col], new]))
            for gap, at in ((gap, at[: gap.size]), (near, at[gap.size :])):  # noqa: B020, PLW2901
                agenda[gap, row] = np.where(at < 0, NEVER, self.pairs.ranks[at] | gap)
                made[gap, col] = self.pairs.made[at]

    def _heaped(self, sym: np.ndarray, skips: Iterator[bool]) -> None:
        """The same for one long chunk: an agenda that is a heap."""
        n = len(sym)
        parts, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def candidates(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
            at = self.pairs(left, right)
            return np.where(at < 0, -1, self.pairs.ranks[at]).tolist(), self.pairs.made[at].tolist()

        ranks, made = candidates(sym[:-1], sym[1:])
        #: Order, left and right place, the two parts and what they become; out of date once one of the two has changed.
        agenda = [(r, i, i + 1, parts[i], parts[i + 1], m) for i, (r, m) in enumerate(zip(ranks, made, strict=True)) if r >= 0]
        heapq.heapify(agenda)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while agenda:
            _, left, right, a, b, new = heapq.heappop(agenda)
            if parts[left] != a or parts[right] != b or after[left] != right or next(skips):
                continue
            parts[left], parts[right] = new, -1
            after[left] = far = after[right]
            if far < n:
                before[far] = left
            for i, j in ((left, far), (before[left], left)):
                if i < 0 or j >= n:
                    continue
                pair = parts[i], parts[j]
                if pair not in known:
                    (r,), (m,) = candidates(np.array([pair[0]]), np.array([pair[1]]))
                    known[pair] = r, m
                r, m = known[pair]
                if r >= 0:
                    heapq.heappush(agenda, (r, i, j, *pair, m))
        sym[:] = parts

    def encode_many(self, texts: list[str], dropout: float = 0.0, seed: int = 0) -> list[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers."""
        skips = [Skips(t, dropout, seed) for t in texts]
        limit = skips[0].limit if skips else 0
        given = [" " + t if t else "" for t in texts]
        ends = np.cumsum([len(t) for t in given], dtype=np.int64)
        chars = np.frombuffer("".join(given).encode("utf-32-le"), "<u4").astype(np.int32)
        if not chars.size:
            return [np.zeros(0, "<u4") for _ in texts]
        # Chunks, as CHUNK has them.
        alone, space = (chars == ord("\n")) | (chars == ord(SPACE)), chars == ord(" ")
        opens = alone | space
        opens[1:] &= ~(space[1:] & space[:-1])
        opens[1:] |= alone[:-1]
        begun = ends[:-1][ends[:-1] < chars.size]
        opens[0] = opens[begun] = True
        first = np.flatnonzero(opens)
        length = np.diff(first, append=chars.size)
        owner = np.searchsorted(ends, first, side="right")
        place = (np.arange(first.size) - np.searchsorted(first, ends - [len(t) for t in given])[owner]).astype(U)
        key = np.array([s.key for s in skips], U)[owner]
        sym = self.symbol_of[chars]
        sym[chars == ord(SPACE)] = self.other
        at_once = length <= SCANNED
        low = 1
        for width in WIDTHS:
            some = np.flatnonzero(at_once & (length > low) & (length <= width))
            for part in (some[k : k + ROWS] for k in range(0, some.size, ROWS)):
                where = first[part] + np.arange(width)[:, None]
                there = np.arange(width)[:, None] < length[part]
                held = np.full((width + 1, part.size), self.other, np.int32)
                held[:-1][there] = sym[where[there]]
                self._merge(held, place[part], key[part], limit)
                sym[where[there]] = held[:-1][there]
            low = width
        for k in np.flatnonzero(~at_once & (length > 1)).tolist():
            self._heaped(sym[first[k] : first[k] + length[k]], skips[owner[k]].drawn(int(place[k])))
        # Symbols to ids; characters that are no pieces to the ids of their bytes.
        left = np.flatnonzero(sym >= 0)
        ids = self.id_of[sym[left]]
        named = ids >= 0
        code = chars[left]
        size = np.where(named, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        stop = np.cumsum(size)
        out = np.zeros(stop[-1], "<u4")
        out[(stop - size)[named]] = ids[named]
        code, size, begin = code[~named], size[~named], (stop - size)[~named]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            more = k < size
            shifted = code[more] >> 6 * (size[more] - 1 - k)
            out[begin[more] + k] = self.byte_ids[shifted | lead[size[more]] if k == 0 else shifted & 0x3F | 0x80]
        return np.split(out, np.append(0, stop)[np.searchsorted(left, ends[:-1])])

    def encode(self, text: str, dropout: float = 0.0, seed: int = 0) -> list[int]:
        return self.encode_many([text], dropout, seed)[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoded(ids).decode("utf-8", "replace")

    def decoded(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))[1:]


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """texts in runs of about TOGETHER characters; a longer text stands alone."""
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


ENCODED = "doc_id long, n_ids long, ids_crc32 long, decoded_bytes long, decoded_sha256 string, lossless boolean"


def encode_documents(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, keep_ids: bool = False) -> DataFrame:
    """Encodes every text of `docs` (doc_id, text), decodes the ids again and describes both; keep_ids adds the column ids.

    Merges are skipped by a hash of seed, text, the chunk's place and the candidate's turn: equal texts give equal ids, and a word is
    cut anew wherever it stands. Null or empty text: no ids. Repeated rows, null ids and extra columns do no
    harm (extra columns are left out); an empty table gives an empty result. A space mark (U+2581) in a text is kept as bytes.
    """
    ship(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = shipped(model_path)
        model = _model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                cols: list[list] = [[], [], [], [], [], []]
                for group in _groups([t or "" for t in some.column("text").to_pylist()]):
                    for text, ids in zip(group, model.encode_many(group, dropout, seed), strict=True):
                        raw, back = text.encode(), model.decoded(ids.tolist())
                        for c, x in zip(cols, (ids.size, zlib.crc32(ids.tobytes()), len(back), hashlib.sha256(back).hexdigest(), back == raw, ids.tolist() if keep_ids else None), strict=True):
                            c.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
                names = ["doc_id", "n_ids", "ids_crc32", "decoded_bytes", "decoded_sha256", "lossless", "ids"]
                n = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[:n], kinds, strict=False))], names[: n + 1])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ENCODED + (", ids array<int>" if keep_ids else ""))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds `text` to a table with a column ids (array<int>); null ids give null."""
    ship(encoded.sparkSession, model_path)

    @F.pandas_udf("string")
    def text(ids):  # type: ignore[no-untyped-def]
        model = _model(shipped(model_path))
        return ids.map(lambda x: None if x is None else model.decode(list(x)))

    return encoded.withColumn("text", text("ids"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids with a tenth of the merges skipped, and what they decode to; nulls and repeats as in encode_documents."""
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, seed=0)
