"""Fill-in-middle: a Split pre-tokenizer with isolated matches of one code point each gives a text's offsets, without any training. Their
number is the text's length, and offsets by rank are the places at which a keyed hash cuts it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, read, ship

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts are matched chunk by chunk: as every match is one code point, none reaches over an end. A word and the space after it is a
#: chunk, and longer words are several, so that most chunks of a text have been seen.
CHUNK = re.compile(r"[^ ]{1,24} ?| ")
#: Chunks whose offsets a worker remembers, some 200 bytes each.
REMEMBERED = 200_000


class Offsets:
    """Where the matches of a Split pre-tokenizer begin."""

    def __init__(self) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(r"[\s\S]"), "isolated")
        self.seen: dict[str, tuple[int, ...]] = {}

    def of_chunk(self, chunk: str) -> tuple[int, ...]:
        """The offsets of the matches in chunk, and its end."""
        out = self.seen.get(chunk)
        if out is None:
            out = (*(a for _, (a, _) in self.split.pre_tokenize_str(chunk)), len(chunk))
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[chunk] = out
        return out

    def of_text(self, text: str) -> RankedOffsets:
        chunks = CHUNK.findall(text)
        return RankedOffsets([self.of_chunk(c) for c in chunks], np.fromiter(map(len, chunks), np.int64, len(chunks)))


class RankedOffsets:
    """The offsets of a text, as those of its chunks and the chunks' lengths."""

    def __init__(self, offsets: list[tuple[int, ...]], lengths: np.ndarray) -> None:
        self.offsets = offsets
        self.before = np.concatenate(([0], np.cumsum(np.fromiter((len(o) - 1 for o in offsets), np.int64, len(offsets)))))
        self.starts = np.concatenate(([0], np.cumsum(lengths)))

    def __len__(self) -> int:
        return int(self.before[-1])

    def at(self, rank: int) -> int:
        """Where the match of this rank begins, counted from 0; after the last one the text's end."""
        if rank >= len(self):
            return int(self.starts[-1])
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.starts[k]) + self.offsets[k][rank - int(self.before[k])]


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers below 2**32 from seed and id; a null id is like an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(text: str, doc_id: int | None, offsets: Offsets, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and the output of one text."""
    ranked = offsets.of_text(text)
    n = len(ranked)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= plain_from or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ranked.at(low), ranked.at(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


FILLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of `docs` (doc_id, text).

    n: the text's code points. form: plain (the text as it is; of every hundred texts those with a draw from plain_from up, the empty
    ones and those that hold a mark), spm (suffix first, draws below spm_below) or psm. The cuts are drawn from seed and id alone, so
    rows of one id are cut at like draws. Null text is empty; a null id is like an empty one; repeated rows give equal rows; other
    columns are left out, so no name can clash; an empty table gives an empty result. A text of any length is one row: its chunks take
    some 100 bytes a word while it is cut.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = Offsets()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for some, _, _ in parts(batches, 4 << 20):
            ids, texts = some.column("doc_id"), some.column("text").to_pylist()
            rows = [rearranged(t or "", i, offsets, seed, plain_from, spm_below) for t, i in zip(texts, ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, FILLED)


def restored(filled: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from `output` and `form` alone. A cut may leave part of a mark at an end of a piece, but no mark
    arises from that, as none begins with the end of another."""
    piece = F.split("output", "<[PSM]>", -1)
    prefix, suffix = F.when(F.col("form") == "psm", piece[1]).otherwise(F.get(piece, 2)), F.when(F.col("form") == "psm", F.get(piece, 2)).otherwise(F.get(piece, 1))
    return filled.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(prefix, F.get(piece, 3), suffix)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and hashes of its output and of the text rebuilt from it; nulls and repeats as in fill_in_middle."""
    out = restored(fill_in_middle(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM drawn
), formed AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, lo) || '<S>' || substr(t, hi + 1) || '<M>' || substr(t, lo + 1, hi - lo)
    ELSE '<S>' || substr(t, hi + 1) || '<P>' || substr(t, 1, lo) || '<M>' || substr(t, lo + 1, hi - lo) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM formed
"""
