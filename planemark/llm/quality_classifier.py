"""Quality classifier by co-training: a classifier of the text's content and one of the page's metadata exchange confident
pseudo-labels over rounds; their calibrated views are combined to score all documents.

In every round both views score all documents without a label, and the most confident share of each class gives pseudo-labels to the
other view. The models are fitted on bounded samples of labelled and pseudo-labelled rows (max_labelled, max_pseudo), the bounds
being parameters; scoring covers every row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, ship, stored

SPACE_BITS = 20
FEATURES = 1 << (SPACE_BITS + 1)
NOT_LETTERS = re.compile(r"[\W\d_]+")
REMEMBERED = 250_000
_features: dict[str, int] = {}


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode()) >> (32 - SPACE_BITS)


def word_feature(word: str) -> int:
    return _hashed(NOT_LETTERS.sub("", word).lower())


def _bin(name: str, value: float) -> int:
    return (1 << SPACE_BITS) + _hashed(f"{name} {int(value)}")


def text_features(text: str) -> list[int]:
    """Distinct features of a text: its words without case and marks, and its shape in coarse bins."""
    words = text.split()
    kinds = set(words)
    if len(_features) > REMEMBERED:
        _features.clear()
    get = _features.get
    out = set()
    for w in kinds:
        f = get(w)
        if f is None:
            f = word_feature(w)
            if len(w) <= 48:
                _features[w] = f
        out.add(f)
    n, chars = max(1, len(words)), max(1, len(text))
    upper = sum(map(str.isupper, words))
    marks = sum(text.count(c) for c in "#*$%&|<>{}[]=_~^\\")
    out |= {
        _bin("words", math.log2(n)), _bin("kinds", 10 * len(kinds) / n), _bin("upper", 10 * upper / n), _bin("marks", 20 * min(1, marks / n)),
        _bin("cries", 10 * min(1, text.count("!") / n)), _bin("digits", 20 * sum(map(text.count, "0123456789")) / chars),
        _bin("length", min(20, chars / n)), _bin("lines", min(10, math.log2(1 + text.count("\n")))), _bin("stops", min(10, 20 * text.count(".") / n)),
    }
    return sorted(out)


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    size = -1 if n_chars is None else int(2 * math.log2(1 + max(0, n_chars)))
    return [_hashed(x) for x in (f"lang {lang}", f"source {source}", f"size {size}", f"lang {lang} size {size}")]


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)), lengths


class Linear:
    """Logistic regression over sets of features, with those that at least `least` training rows have. labels: 0 to 1."""

    def __init__(self, rows: list, labels: np.ndarray, weights: np.ndarray, least: int = 3, decay: float = 1.0, steps: int = 150):
        flat, lengths = _flat(rows)
        self.names, counts = np.unique(flat, return_counts=True)
        self.names = self.names[counts >= least]
        k = np.minimum(np.searchsorted(self.names, flat), max(0, len(self.names) - 1))
        known = self.names[k] == flat if len(self.names) else np.zeros(len(flat), bool)
        row, col = np.repeat(np.arange(len(lengths)), lengths)[known], k[known]
        y = labels.astype(float)
        n, d = len(rows), len(self.names)
        w, b = np.zeros(d), 0.0
        m, v = np.zeros(d + 1), np.zeros(d + 1)
        total = max(1e-9, weights.sum())
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -30, 30)))
            r = (p - y) * weights
            g = np.append((np.bincount(col, r[row], d) + decay * w) / total, r.sum() / total)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w, float(b)

    def table(self) -> np.ndarray:
        """The weight of every feature."""
        out = np.zeros(FEATURES, np.float32)
        out[self.names] = self.w
        return out

    def margins(self, flat: np.ndarray, lengths: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        row = np.repeat(np.arange(len(lengths)), lengths)
        return np.bincount(row, (self.table() if table is None else table)[flat], len(lengths)) + self.b


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's a, b: the probability is the logistic of a * margin + b. Targets are smoothed, a is not negative."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + np.array([1e-3 * (w[0] - 1), 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(0.0, float(w[0])), float(w[1])


Pseudo = tuple[list, np.ndarray]
#: What a pseudo-labelled row weighs beside a labelled one.
PSEUDO_WEIGHT = 0.1


class CoTrained:
    """Two calibrated views fitted on labelled rows and on rows that the other view is sure of (features and chances of `good`)."""

    def __init__(self, views: list[list], labels: np.ndarray, fold: np.ndarray, given: list[Pseudo]):
        train = np.flatnonzero(fold != 0) if (fold != 0).any() and (fold == 0).any() else np.arange(len(labels))
        check = np.flatnonzero(fold == 0) if len(train) < len(labels) else train
        self.prior = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        self.received = [len(rows) for rows, _ in given]
        self.models: list[Linear] = []
        self.scales: list[tuple[float, float]] = []
        for own, (rows, chances) in zip(views, given, strict=True):
            model = Linear([own[i] for i in train] + rows, np.concatenate((labels[train], chances)), np.repeat([1.0, PSEUDO_WEIGHT], [len(train), len(rows)]))
            self.models.append(model)
            self.scales.append(calibrated(model.margins(*_flat([own[i] for i in check])), labels[check]))

    def logits(self, view: int, flat: np.ndarray, lengths: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        a, b = self.scales[view]
        return np.clip(a * self.models[view].margins(flat, lengths, table) + b, -30, 30)

    def tables(self) -> list[np.ndarray]:
        return [m.table() for m in self.models]

    def score(self, text: list, meta: list, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """The chance of good quality, the views taken as independent given the class."""
        prior = math.log(self.prior / (1 - self.prior))
        both = sum(self.logits(v, *_flat(rows), table) for v, (rows, table) in enumerate(zip((text, meta), tables or self.tables(), strict=True))) - prior
        return 1 / (1 + np.exp(-np.clip(both, -30, 30)))


VIEWS = ("text_view", "meta_view")
ROWS = "doc_id long, row long, text_view array<int>, meta_view array<int>"
#: Logits are ranked in steps of 1 / STEPS.
STEPS = 100


def _row_features(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text) and both views' features of docs, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [text_features(x or "") for x in b.column("text").to_pylist()]
                metas = [metadata_features(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(texts, pa.list_(pa.int32())), pa.array(metas, pa.list_(pa.int32()))], ["doc_id", "row", *VIEWS])

    return docs.withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(run, ROWS)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _ranked(pool: DataFrame, model: CoTrained) -> list[dict[int, int]]:
    """For each view, how many rows of the pool have which logit, in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for v, c in enumerate(VIEWS):
                step, n = np.unique(np.round(model.logits(v, *_lists(batch.column(c)), tables[v]) * STEPS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), v, np.int32)), pa.array(step), pa.array(n)], ["view", "step", "n"])

    # At most 60 * STEPS + 1 steps a view, whatever the input.
    out: list[dict[int, int]] = [{}, {}]
    for r in pool.select(*VIEWS).mapInArrow(run, "view int, step long, n long").groupBy("view", "step").agg(F.sum("n").alias("n")).collect():
        out[r["view"]][r["step"]] = r["n"]
    return out


def _limits(ranked: dict[int, int], prior: float, share: float) -> tuple[float, float, int, int]:
    """The steps up to which and from which on rows are the surest `share` of the bad and of the good, and how many these are.

    Rows of one step go together; the surest step of a class is always in, and no row is in both.
    """
    steps = sorted(ranked)
    total = sum(ranked.values())
    found = []
    for order, part in ((steps, 1 - prior), (steps[::-1], prior)):
        n, last = 0, None
        for k in order:
            if last is not None and n + ranked[k] > share * part * total:
                break
            n, last = n + ranked[k], k
        found.append((last, n))
    (low, n_low), (high, n_high) = found
    return (low, high, n_low, n_high) if low < high else (-math.inf, math.inf, 0, 0)


def _exchanged(pool: DataFrame, model: CoTrained, share: float, max_pseudo: int) -> list[Pseudo]:
    """For each view, rows with chances of `good` from the other: of the surest share of each class among all rows of the pool, a
    sample of about max_pseudo by their hashes."""
    ranked = _ranked(pool, model)
    if not ranked[0]:
        return [([], np.zeros(0)), ([], np.zeros(0))]
    limits = [_limits(r, model.prior, share) for r in ranked]
    # Of n rows those with the smallest hashes, as many as the bound in the mean.
    most = [[min(1.0, max_pseudo / max(1, n)) * 2.0**63 for n in x[2:]] for x in limits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            spread = batch.column("row").to_numpy().astype(np.uint64) >> np.uint64(1)
            for v, c in enumerate(VIEWS):
                logits = model.logits(v, *_lists(batch.column(c)), tables[v])
                step = np.round(logits * STEPS)
                sure = ((step <= limits[v][0]) & (spread < most[v][0])) | ((step >= limits[v][1]) & (spread < most[v][1]))
                at = np.flatnonzero(sure)
                chances = np.round(1 / (1 + np.exp(-logits[at])), 6)
                other = batch.column(VIEWS[1 - v]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 1 - v, np.int32)), batch.column("row").take(pa.array(at)), pa.array(chances), other], ["view", "row", "chance", "features"])

    # Repeated rows share a hash, so one stands for all; the limit is never met but by chance.
    found = pool.select("row", *VIEWS).mapInArrow(run, "view int, row long, chance double, features array<int>").dropDuplicates(["view", "row"])
    out: list[Pseudo] = []
    for v in (0, 1):
        rows = found.where(F.col("view") == v).orderBy("row").limit(3 * max_pseudo).toArrow()
        out.append(([x.values.to_numpy() for x in rows.column("features")], rows.column("chance").to_numpy()))
    return out


def _source(docs: DataFrame) -> DataFrame:
    has = {c.lower() for c in docs.columns}
    column = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    return docs.select(column("doc_id", "long"), column("text", "string"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))


#: Up to so many labelled ids are broadcast (16 bytes each); more meet the rows in a shuffle.
BROADCAST_IDS = 1_000_000


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_pseudo: int = 2_000, rounds: int = 3, share: float = 0.03) -> CoTrained | None:
    """Fits on at most max_labelled labelled rows, those of the smallest hashes, and on about max_pseudo pseudo-labelled ones of each
    class and view, from the surest `share` of all rows without a label.

    labels: doc_id and good (0 or 1); rows with nulls are left out, of contradicting rows of an id the smallest counts. None if no
    labelled row is in docs or all have one class.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good").cast("int").alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good"))
    known = stored(known, "labels")
    side = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    features = stored(_row_features(_source(docs)).join(side, "doc_id", "left"), "features")
    labelled = features.where("good IS NOT NULL")
    n = labelled.agg(F.approx_count_distinct("row")).first()[0]
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(3), "row"), 11)
    fold = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).cast("int").alias("fold")
    # About twice as many as wanted at most meet in the sort.
    some = labelled.where(spread <= int(min(1.0, 2 * max_labelled / max(1, n)) * 2**53)).dropDuplicates(["row"])
    rows = some.orderBy(spread, "row").limit(max_labelled).select(*VIEWS, "good", fold).toArrow()
    good, folds = rows.column("good").to_numpy(), rows.column("fold").to_numpy()
    model = None
    if len(set(good.tolist())) == 2:
        views = [[x.values.to_numpy() for x in rows.column(c)] for c in VIEWS]
        pool = features.where("good IS NULL")
        model = CoTrained(views, good, folds, [([], np.zeros(0))] * 2)
        for _ in range(rounds):
            model = CoTrained(views, good, folds, _exchanged(pool, model, share, max_pseudo))
    discard(features, known)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 8_000, max_pseudo: int = 2_000, rounds: int = 3) -> DataFrame:
    """Adds quality_score (0 to 1) and quality_kept to every row of `docs` (doc_id, text, and lang, source, n_chars if there).

    Null or empty text has the features of no words; texts of any length are read whole. Without labels of both classes nothing is
    known, so all rows get 0.5 and stay. Repeated rows and null ids are scored like others. An empty table gives an empty result.
    Columns of docs named like the new ones are replaced.
    """
    given = [c for c in docs.columns if c.lower() not in ("quality_score", "quality_kept")]
    docs = docs.select(*(F.col(f"`{c}`") for c in given))
    model = fit(docs, labels, max_labelled, max_pseudo, rounds)
    if model is None:
        return docs.withColumn("quality_score", F.lit(0.5)).withColumn("quality_kept", F.lit(True))

    import pandas as pd

    def scored_parts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:

        tables = model.tables()
        for text, lang, source, n_chars in parts:
            out = []
            for at in range(0, len(text), 256):
                piece = slice(at, at + 256)
                meta = [metadata_features(a, b, None if c is None or c != c else int(c)) for a, b, c in zip(lang[piece], source[piece], n_chars[piece], strict=True)]
                out.append(np.round(model.score([text_features(x or "") for x in text[piece]], meta, tables), 6))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored_parts.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    score = F.pandas_udf(scored_parts, "double")
    has = {c.lower() for c in docs.columns}
    column = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    scored = docs.withColumn("quality_score", score(column("text", "string"), column("lang", "string"), column("source", "string"), column("n_chars", "long")))
    return scored.withColumn("quality_kept", F.col("quality_score") >= threshold)


def good_labels(labels: DataFrame) -> DataFrame:
    """Good: of quality and not toxic."""
    return labels.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("good"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the co-trained views, fitted on `labels`; nulls and repeats as in classify."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return classify(docs, good_labels(read(spark, sf_dir, "labels"))).select("doc_id", "quality_score", F.col("quality_kept").alias("kept"))
