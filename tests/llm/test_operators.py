"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from planemark.llm import lines, media, ngram_join, packing, pieces, quality_classifier, quality_rules, substrings, suffixes, url_filters
from planemark.llm.queries import QUERIES
from planemark.llm.suffix_array import shared_windows, suffix_array

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, row_key long, bucket int, kept_text string, n_lines string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = make(80), make(150)
    out = [make(rng.randint(1, 200)) for _ in range(30)]
    out += [make(30) + " " + passage + "\n" + make(20) for _ in range(6)]
    for k in range(8):  # near copies
        words = base.split()
        words[k * 7] = f"edit{k}"
        out.append(" ".join(words))
    out += [base, base, base.upper(), "same words " * 200, "x" * 30000, "\t\x0b \r\n", "", None, "one", "one", "two words"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, i, 0, "k", "n") for i, t in enumerate(texts)] + [(None, texts[0], 0, 0, "k", "n"), (None, None, 0, 0, "k", "n"), (3, texts[3], 3, 0, "k", "n")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(want, key=repr)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# 1


def test_netpbm_and_bmp_round_trips():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    for raw in (media.encode_pgm(grey), media.encode_bmp(grey), b"P2 # note\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()):
        assert (media.decode(raw) == grey).all()
    rgb = rng.integers(0, 256, (2, 3, 3), dtype=np.uint8)
    assert (media.decode(b"P6\n3 2\n255\n" + rgb.tobytes()) == rgb).all()
    assert media.decode(b"P1\n3 2\n101\n0 1 0").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 1, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    bmp24 = bytearray(media.encode_bmp(np.zeros((1, 1), np.uint8))[:54])
    bmp24[10:14], bmp24[28:30] = (54).to_bytes(4, "little"), (24).to_bytes(2, "little")
    assert media.decode(bytes(bmp24) + b"\x01\x02\x03\x00").tolist() == [[[3, 2, 1]]]
    for bad in (b"", b"P5\n", b"P5\n9 9\n255\nxx", b"BM", b"P9\n1 1"):
        with pytest.raises((media.MediaError, ValueError)):
            media.decode(bad)


def test_area_resize_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(20):
        h, w = rng.integers(1, 12, 2)
        a, b = rng.integers(1, 9, 2)
        image = rng.integers(0, 256, (h, w)).astype(np.uint8)
        big = np.kron(image, np.ones((a, b), int))  # cells are whole there
        want = big.reshape(a, h, b, w).transpose(0, 2, 1, 3).sum(axis=(2, 3))
        assert (media.area_sums(image, int(a), int(b)) == want).all()
    t = media.tiles(np.arange(40 * 50, dtype=np.uint16).reshape(40, 50), 32)
    assert [(y, x) for y, x, _ in t] == [(0, 0), (0, 32), (32, 0), (32, 32)]
    import io

    assert np.load(io.BytesIO(t[3][2])).shape == (8, 18)


def test_op1_contract(spark, docs):
    got = {}
    for r in media.text_media(docs, keep_bytes=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    for i, t in rows_of(docs):
        raw = t.encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = next(r for r in got[i] if r.n_bytes == len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and media.decode(bytes(r.media)).tobytes() == padded
    assert media.text_media(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.eye(9, dtype=np.uint8)))), (2, bytearray(b"junk")), (3, None)], "k int, content binary")
    out = {r.k: r.media for r in media.decode_media(df).collect()}
    assert out[1].height == 9 and len(out[1].tiles) == 1 and out[2].error and out[3].error


# 2


def test_op2_against_brute_force(spark, docs):
    rows = rows_of(docs)
    least = {}
    for i, t in rows:
        w, rank = WORD.findall(t.encode()), 2**63 - 1 if i is None else i
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(rank, least.get(key, rank))
    want = []
    for i, t in rows:
        w, rank = WORD.findall(t.encode()), 2**63 - 1 if i is None else i
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < rank:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert any(x[2] for x in want)
    same(substrings.repeated_spans(docs).select("doc_id", "n_words", "n_removed", "kept_sha256"), want)
    assert substrings.repeated_spans(empty(spark)).count() == 0


# 3


def test_suffix_arrays_against_sorting():
    rng = random.Random(1)
    for _ in range(200):
        t = [rng.randint(1, rng.choice([1, 2, 26])) for _ in range(rng.randint(1, 60))] + [0]
        assert suffix_array(np.array(t, np.int16), 27).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    for _ in range(200):
        parts = [bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        size = rng.randint(1, 8)
        count = collections.Counter(s[i : i + size] for s in parts for i in range(len(s) - size + 1))
        want = [i + size <= len(s) and count[s[i : i + size]] > 1 for s in parts for i in range(len(s))]
        assert shared_windows(np.frombuffer(b"".join(parts), np.uint8), np.array([len(s) for s in parts]), size).tolist() == want


def removed_bytes(rows, size):
    count = collections.Counter()
    for _, t in rows:
        x = t.encode()
        count.update(x[k : k + size] for k in range(len(x) - size + 1))
    out = []
    for i, t in rows:
        x = t.encode()
        mark = bytearray(len(x))
        for k in range(len(x) - size + 1):
            if count[x[k : k + size]] > 1:
                mark[k : k + size] = b"\1" * size
        kept = bytes(b for b, m in zip(x, mark, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(mark) if m and (not k or not mark[k - 1]))
        out.append((i, len(x), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("size", "most"), [(400, 1200), (100, 2)])
def test_op3_against_brute_force(spark, docs, monkeypatch, size, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    want = removed_bytes(rows_of(docs), size)
    assert any(x[2] for x in want)
    same(suffixes.repeated_bytes(docs, size).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)
    if most > 2:
        assert suffixes.repeated_bytes(empty(spark)).count() == 0


# 4


def classes(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent", "rare"), [(3, 90, 32), (5, 80, 0)])
def test_op4_against_brute_force(spark, docs, size, percent, rare):
    want = classes(rows_of(docs), size, percent)
    assert sum(c is not None and c != i for i, _, c in want) > 5
    same(ngram_join.similarity_classes(docs, size, percent, rare), want)
    if rare:
        assert ngram_join.similarity_classes(empty(spark)).count() == 0


def test_pairs_of_frequent_tokens_find_what_centres_miss(spark):
    """Chains in which no centre is near all: the links must come from the index of pairs, too."""
    words = [f"w{k}" for k in range(400)]
    chain = [" ".join(words[k * 9 : k * 9 + 160]) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.similarity_classes(df, 3, 80, 0), classes(rows, 3, 80))


@pytest.mark.parametrize(("percent", "rare"), [(90, 0), (80, 0), (60, 0), (90, 3)])
def test_similar_sets_share_a_key_of_the_index(spark, percent, rare):
    """Sets of 1 to 900 tokens beside ones that are just similar enough: every similar pair has a key in common, whatever the sizes'
    classes, and the index has a bounded number of rows a token."""
    rng = random.Random(percent)
    sets = []
    for n in [1, 2, 3, 7, 15, 16, 31, 40, 64, 100, 130, 250, 255, 256, 400, 512, 600, 800, 900]:
        for _ in range(3):
            base = rng.sample(range(1200), n)
            sets.append(set(base))
            fewer = n * percent // 100 + (n * percent % 100 > 0)
            sets.append(set(rng.sample(base, fewer)))
            most = int(n * (100 - percent) / (100 + percent))
            other = set(rng.sample(base, n - most))
            sets.append(other | set(rng.sample(sorted(set(range(1200)) - set(base)), n - len(other))))
    df = collections.Counter(x for s in sets for x in s)
    rows = []
    for i, s in enumerate(sets):
        shared = sorted((x for x in s if df[x] > 1), key=lambda x: (df[x], x))
        rows.append((i, len(s), len(shared), sum(df[x] <= rare for x in shared), 0, shared))
    reps = spark.createDataFrame(rows, "id long, n long, n_shared long, n_rare long, mass long, tokens array<long>")
    longer = ngram_join._longer(reps, percent)
    assert longer.where("coarse <> fine").count() > 0
    index = ngram_join._combined(ngram_join._labelled(longer, None, 0, *ngram_join.CLASSED)).select("id", "k").collect()
    keys = collections.defaultdict(set)
    for r in index:
        keys[r.id].add(r.k)
    found = 0
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                assert sets[a] == sets[b] or keys[a] & keys[b], (len(sets[a]), len(sets[b]))
                found += sets[a] != sets[b]
    assert found > 60 and len(index) < 24 * longer.count()


def test_op4_long_texts_under_frequent_words(spark):
    """Texts of some 1,800 words made of blocks that nearly all of them have: all their words are frequent, and the threshold parts them."""
    rng = random.Random(8)
    blocks = [" ".join(f"b{k}x{rng.randrange(10**6)}" for _ in range(40)) for k in range(50)]
    rows = [(i, " ".join(x for k, x in enumerate(blocks) if k not in left)) for i in range(48) for left in [set(rng.sample(range(50), rng.choice([3, 4, 5])))]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (90,):
        want = classes(rows, 3, percent)
        assert len({c for _, _, c in want}) > 1
        same(ngram_join.similarity_classes(df, 3, percent), want)


# 5


def test_op5_contract(spark, docs):
    path = P.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, keep_ids=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    pieces_ = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[i, k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert pieces_ == want
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_plans_are_whole_and_tight():
    rng = random.Random(5)
    for n, shape in ((3000, (1, 300)), (2000, (200, 2048)), (500, (700, 1100)), (400, (1024, 1024))):
        lengths = collections.Counter(rng.randint(*shape) for _ in range(n))
        plan = packing.Plan(dict(lengths))
        assert plan.taken == dict(lengths)
        used = collections.defaultdict(list)
        for length, _, count, first, offset in plan.slots:
            for s in range(first, first + count):
                used[s].append((offset, length))
        for own in used.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        plain = packing.Rooms(2048)  # best fit, longest first
        for length in sorted(lengths, reverse=True):
            plain.fit(length, lengths[length])
        assert len(used) == plan.sequences <= plain.sequences()


# 6


def test_op6_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf, 'documents.parquet')}'")
    same(lines.op6_line_dedup(spark, sf).select("doc_id", "kept_sha256", "n_dropped", "n_lines"), con.sql(f"SELECT doc_id, kept_sha256, n_dropped, n_lines FROM ({lines.OP6_SQL})").fetchall())


def test_line_rules(spark):
    rows = [(i, f"Ähre KEEP {i}\n  Common Line\t\nÄB\n\n") for i in range(3)] + [(None, "common line"), (9, None), (9, "äb\nCOMMON LINE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_text", F.lit("clash"))
    out = {(r.doc_id, r.text): (r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_common_lines(df, min_docs=3).collect()}
    assert out[0, rows[0][1]] == (5, 2, "Ähre KEEP 0\n\n")  # A-Z alone are lowered: ÄB is Äb here, äb there
    assert out[None, "common line"] == (1, 1, "") and out[9, None] == (1, 0, "") and out[9, rows[5][1]] == (2, 1, "äb")
    assert lines.drop_common_lines(empty(spark)).count() == 0


# 7


def test_classifier_on_held_out_rows(spark, sf):
    d = sf.replace("0.001", "0.1")  # some 4,000 labels; with a few hundred, rare words of toxic texts are not learnt
    labels = quality_classifier.good_labels(spark.read.parquet(f"{d}/labels.parquet"))
    train, held = labels.where("pmod(xxhash64(9, doc_id), 3) > 0"), labels.where("pmod(xxhash64(9, doc_id), 3) = 0")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = quality_classifier.classify(docs, train).join(held, "doc_id").select("good", "quality_kept").collect()
    right = sum(bool(r.good) == r.quality_kept for r in out) / len(out)
    good = [r.quality_kept for r in out if r.good]
    print("accuracy", right, "good kept", sum(good) / len(good))
    assert right > 0.9 and sum(good) / len(good) > 0.95, (right, sum(good) / len(good))


def test_views_exchange_labels(spark, sf):
    """Both views get pseudo-labels of both classes from the other, and are other models for it."""
    d = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), quality_classifier.good_labels(spark.read.parquet(f"{d}/labels.parquet"))
    alone, together = quality_classifier.fit(docs, labels, rounds=0), quality_classifier.fit(docs, labels, rounds=2, share=0.1)
    assert alone.received == [0, 0] and min(together.received) > 10
    assert all(a != b for a, b in zip(alone.scales, together.scales, strict=True))
    bounded = quality_classifier.fit(docs, labels, max_labelled=100, max_pseudo=5, rounds=1, share=0.1)
    assert max(bounded.received) <= 30


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id long, good int")
    out = quality_classifier.classify(docs.withColumn("quality_score", F.lit("x")), labels)
    assert out.count() == docs.count() and out.where("NOT quality_kept").isEmpty()
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, good int")
    out = quality_classifier.classify(docs, labels)
    assert out.count() == docs.count() and out.where("quality_score IS NULL").isEmpty()
    assert quality_classifier.classify(empty(spark), labels).count() == 0


# 8


def base(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {x for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    real = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(real) - len(set(real)), len(again)


def llr(texts, trusted):
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    seed = lambda b, s: xxhash.xxh64_intdigest(b, s)

    def buckets(t):
        hs = [seed(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0d]+", t)]
        pairs = [seed(b.to_bytes(8, "little"), seed(a.to_bytes(8, "little"), 42)) for a, b in zip(hs, hs[1:], strict=False)]
        return [h >> 50 for h in hs + pairs]

    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for k, t in enumerate(texts):
        np.add.at(raw, buckets(t), 1)
        if k in trusted:
            np.add.at(target, buckets(t), 1)
    n = quality_rules.BUCKETS
    weights = np.round(1e6 * (np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n)))).astype(int)
    assert signed(2**64 - 1) == -1
    return [int(sum(weights[b] for b in buckets(t))) for t in texts]


def test_op8_against_brute_force(spark, docs):
    rows = rows_of(docs)
    trusted = spark.createDataFrame([(0,), (5,), (7,), (None,), (5,)], "doc_id long")
    known = {k for k, (i, _) in enumerate(rows) if i in (0, 5, 7)}
    want = []
    for (i, t), total in zip(rows, llr([t for _, t in rows], known), strict=True):
        n, chars, marks, dup, again = base(t)
        failed = n < 10 or 100 * again > 20 * n
        want.append((i, n, chars, marks, dup, again, failed, not failed and total >= -200_000 * n))
    out = quality_rules.score_quality(docs, trusted)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), want)
    assert quality_rules.score_quality(empty(spark), trusted).count() == 0


def test_op8_target_counts_every_trusted_document(spark):
    """With every document trusted both multinomials are one, so no ratio differs from zero."""
    df = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3000))) for k in range(3)]).alias("text"))
    assert quality_rules.score_quality(df, df.select("doc_id")).where("llr <> 0").count() == 0


# 9


def test_pieces_equal_the_library_without_dropout(texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    odd = ["a  b", " a", "a\n b\t c", "  ", "ﬁ ｆ", "a ", "\u0000a", "ab😀", "\n\n a \n  b"]
    for t in [x for x in texts if x][:40] + odd:
        assert model.encode(t) == sp.encode(t)
        cut = model.encode(t + "▁", 0.3, 7)
        assert model.decode(cut) == t + "▁" and cut == model.encode(t + "▁", 0.3, 7)
    assert len({tuple(model.encode(texts[0], 0.2, s)) for s in range(8)}) > 4
    assert len(model.encode(texts[0], 1.0)) > len(model.encode(texts[0]))


def dropped_out(model, text, dropout, seed):
    """By definition: the best candidate of all is decided on, chunk by chunk, until none is left."""
    out, skips = [], pieces.Skips(text, dropout, seed)
    for place, chunk in enumerate(pieces.CHUNK.findall(" " + text)):
        parts, shut, turn = [(k, c) for k, c in enumerate(chunk.replace(" ", pieces.SPACE))], set(), 0
        while chunk != pieces.SPACE:
            open_ = [(model.order[a + b], i, a + b) for (i, a), (j, b) in zip(parts, parts[1:], strict=False) if a + b in model.order and (i, j, a + b) not in shut]
            if not open_:
                break
            _, left, piece = min(open_)
            k = next(k for k, (i, _) in enumerate(parts) if i == left)
            if skips.later(place, turn):
                shut.add((left, parts[k + 1][0], piece))
            else:
                parts[k : k + 2] = [(left, piece)]
            turn += 1
        for _, p in parts if chunk != pieces.SPACE else []:
            out += [model.ids[p]] if p in model.ids else [model.bytes[b] for b in p.encode()]
        out += [model.bytes[b] for b in chunk.encode()] if chunk == pieces.SPACE else []
    return out


def test_op9_dropout_against_brute_force(texts, monkeypatch):
    path = P.path("piece_bpe_32k.model")
    model = pieces.PieceModel(path)
    some = [t[:1500] for t in texts if t][:25] + ["a  b▁ c\n\n Straßenbahn 😀", "internationalization " * 9, "x" * 90]
    for scanned in (0, 48):
        monkeypatch.setattr(pieces, "SCANNED", scanned)
        for dropout in (0.0, 0.1, 0.6):
            assert [model.encode(t, dropout, 5) for t in some] == [dropped_out(model, t, dropout, 5) for t in some]


def test_op9_is_lossless(spark, docs):
    path = P.path("piece_bpe_32k.model")
    out = pieces.encode_documents(docs, path, 0.1, 1, keep_ids=True)
    assert out.where("NOT lossless").isEmpty() and out.count() == docs.count()
    same(pieces.decode_documents(out, path).select("doc_id", "text"), rows_of(docs))
    assert pieces.encode_documents(empty(spark), path).count() == 0


def test_op9_cuts_a_word_anew_at_every_place():
    path = P.path("piece_bpe_32k.model")
    model = pieces.PieceModel(path)
    cut = lambda t, dropout: model.encode_many(["x y", t, ""], dropout, 1)[1].tolist()
    text = " ".join(["international"] * 3000)
    ids, plain = cut(text, 0.1), cut(text, 0.0)
    words = collections.Counter()
    word: list[bytes] = []
    for i in [*ids, None]:
        if word and (i is None or model.raw[i].startswith(b" ")):
            words[tuple(word)] += 1
            word = []
        if i is not None:
            word.append(model.raw[i])
    assert len(words) > 10 and model.decode(ids) == text
    skips = pieces.Skips(text, 0.1, 1)
    bits = np.array([list(itertools.islice(skips.drawn(k), 300)) for k in range(5000)])
    assert (abs(bits.mean(axis=0) - 0.1) < 0.03).all() and bits[7].tolist() == [skips.later(7, k) for k in range(300)]
    for t in (text, "a b\n c " * 50, "x" * 500, "ab▁ cd  éß"):
        for dropout in (0.0, 0.1, 0.5, 1.0):
            assert cut(t, dropout) == model.encode(t, dropout, 1) == cut(t, dropout)
    long = " ".join(f"w{k % 97}é" for k in range(40_000)) + "y" * 3000
    assert model.decode(model.encode(long, 0.3, 2)) == long
    assert cut(text, 0.1) != cut(text + " x", 0.1)[: len(ids)] and plain == model.encode(text)


# 10


def test_op10_links_and_rules(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">t</a>' for h in hosts)
    pages = [
        (1, "https://good.com/fr/a", link("a.net")), (2, "http://BAD.com/de/b", None), (3, "http://a.net/1", link("b.net", "good.com")), (4, "http://c.net/", link("bad.com")),
        (5, None, None), (6, "no address", "<p>"), (7, "https://x.example.org/en/12", ""), (8, "https://x.example.org/es/", ""), (9, "https://example.org?x", ""), (9, "https://example.org?x", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df).collect()}
    assert out[1] == ("good.com", "/fr/a", "com/fr/", "allow") and out[2] == ("bad.com", "/de/b", "com/de/", "block")
    assert out[3][3] == "allow" and out[4][3] == "block"  # distrust comes back along the link to a blocked host
    assert out[5] == out[6] == ("", "", None, "allow")
    assert out[7][2:] == ("example.org/en/1", "block") and out[8][2:] == ("example.org/es/", "block") and out[9] == ("example.org", "", None, "allow")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(x) for x in pages])
    same(url_filters.judge_urls(df).select("page_id", "host", "path", "rule", "verdict"), [tuple(r) for r in con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filters.OP10_SQL})").fetchall()])
    assert url_filters.judge_urls(df.limit(0)).count() == 0


# All


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 0.5 * len(before) < len(left) < len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(left)


def test_pipeline_runs(spark, sf):
    """run() is the stages one after another: whole pieces in full sequences, of documents that all stages kept."""
    got = corpus_pipeline.run(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    ids = {r.doc_id for r in got}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.5 * n < len(ids) < n


CLASHING = ("_row_id", "_key", "_row", "row", "given", "kept_text", "n_lines", "quality_score", "quality_kept", "digest", "component_id", "span_starts", "_text", "id", "none", "drops")


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_tables(spark, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared, long = make(70), make(20000)
    rows = [(1, make(40) + " " + shared), (1, shared + " " + make(40)), (None, make(50)), (None, None), (3, None), (4, ""), (5, long), (6, make(30)), (6, "tie"), (7, "tie\n\n")]
    plain = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    odd = plain.withColumns({c: F.lit("clash") for c in CLASHING})
    key = lambda df: sorted((str(r.doc_id), r.text or "", r.n_chars or 0) for r in df.collect())
    a, b = stage(spark, plain, sf), stage(spark, odd, sf)
    assert a.columns == plain.columns and b.columns == odd.columns
    assert key(a) == key(b)
    assert b.where(" AND ".join(f"`{c}` = 'clash'" for c in CLASHING)).count() == b.count()
    if name != "quality_classifier":
        assert (5 in {r.doc_id for r in a.collect()}) and any(r.doc_id is None for r in a.collect())
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_packing_stage_on_odd_tables(spark, sf):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "word " * 5000)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("length", "piece", "_place", "_part")})
    out = corpus_pipeline.packing_stage(spark, df, sf).collect()
    assert sorted((str(r.doc_id), r.length) for r in out) == [("1", 1), ("1", 905), ("1", 2048), ("1", 2048), ("None", 1)]
    assert corpus_pipeline.packing_stage(spark, df.limit(0), sf).count() == 0


# Hashes


def test_words_of_thue_and_morse_do_not_collide(spark):
    """The word of 1,024 letters and its complement share every polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"{word} {common}"), (2, f"{other} {common}")], "doc_id long, text string")
    assert substrings.repeated_spans(df).agg(F.sum("n_removed")).first()[0] == 0
    one = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.similarity_classes(one, 3, 90).collect()} == {1, 2}
    want = removed_bytes([(1, word), (2, other)], 400)
    same(suffixes.repeated_bytes(one, 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)


def test_similarity_of_half_or_less_is_refused(spark):
    with pytest.raises(ValueError):
        ngram_join.similarity_classes(empty(spark), 3, 50)


def test_long_shards_against_sorting():
    """Real recursion: a text of many names on the second level."""
    rng = random.Random(2)
    words_ = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    t = np.append(np.frombuffer(" ".join(rng.choices(words_, k=110_000)).encode()[:700_000], np.uint8).astype(np.int16) + 2, 0).astype(np.int16)
    sa = suffix_array(t, 258)
    assert (np.sort(sa) == np.arange(len(t))).all()
    rank = np.empty(len(t), np.int64)
    rank[sa] = np.arange(len(t))
    a, b = sa[:-1], sa[1:]
    # By definition: the first character decides, and where it is equal the order of the rests.
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (rank[np.minimum(a + 1, len(t) - 1)] < rank[np.minimum(b + 1, len(t) - 1)]))).all()


def test_ids_of_odd_unicode_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(0)
    pool = [chr(c) for c in (*range(0x21, 0x250), *range(0x300, 0x330))] + list("İıſÅΣς’…—ﬁ١éñ.,;:!?#%&") + ["'s", "\t", "\x0b", "\xa0", " ", " ", "\n"]
    odd = ["".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(3000)] + ["İ+", "aİ+ b", "Abc... DEF'S"]
    assert packing.word_ids(odd, path) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_near_duplicate_stage_keeps_one(spark, docs):
    plain = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    kept = corpus_pipeline.near_duplicate_stage(spark, plain, "").collect()
    want = {i for i, n, c in classes(rows_of(plain), 5, 80) if c == i}
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(5))
    rows = [(1, a), (None, a + " more"), (None, b), (7, c), (7, a + " other"), (None, d), (None, d + " end"), (None, None), (4, e), (4, e), (None, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()), key=repr)
    of_d = [x for x in kept if x[1] in (d, d + " end")]
    assert len(of_d) == 1 and [x for x in kept if x not in of_d] == sorted([(1, a), (None, b), (7, c), (None, None), (4, e)], key=repr)


def test_passage_stage_leaves_clean_text(spark):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    shared, clean = make(60), make(90)
    rows = [(1, make(20) + " " + shared), (2, shared + " " + make(20)), (3, clean), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    out = {r.doc_id: r for r in corpus_pipeline.passage_stage(spark, df, "").collect()}
    assert out[3].text == clean and shared not in out[1].text + out[2].text and out[4].text == "" and out[1].n_chars == len(out[1].text)


@pytest.mark.parametrize(("hot", "percent"), [(2, 90), (2, 95), (64, 80)])
def test_op4_large_groups_without_links(spark, monkeypatch, hot, percent):
    """Near copies of one text that are often not similar enough to one another, under the same frequent tokens."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(220):
        words = base.copy()
        for _ in range(rng.choice([1, 1, 2, 2, 3, 5])):
            words[rng.choice([rng.randrange(90), rng.randrange(12)])] = rng.choice(["u", "v", f"e{i}"])
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(ngram_join.similarity_classes(df, 3, percent), classes(rows, 3, percent))


def test_op10_scores_reach_the_limit(spark):
    """Distrust comes back along a chain of 30 links, beyond any few rounds; scores are those of the linear system."""
    hosts = [f"h{k}.net" for k in range(30)] + ["bad.com"]
    pages = [(k, f"https://{h}/", f'<a href="https://{hosts[k + 1]}/">t</a><a href="https://{hosts[(7 * k) % 30]}/">t</a>') for k, h in enumerate(hosts[:-1])]
    pages.append((30, "https://bad.com/de/", None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.host: r for r in url_filters.judge_urls(df).collect()}
    assert all(r.verdict == "block" for r in out.values())
    n = len(hosts)
    links = np.zeros((n, n))
    for k in range(30):
        for to in {k + 1, (7 * k) % 30} - {k}:
            links[k, to] += 1
    out_shares = links / np.maximum(links.sum(1, keepdims=True), 1)
    back = (out_shares / np.maximum(out_shares.sum(0, keepdims=True), 1e-300)).T
    seed = np.eye(n)[30]
    want = np.linalg.solve(np.eye(n) - url_filters.DAMPING * back.T, (1 - url_filters.DAMPING) * seed)
    assert max(abs(out[h].distrust - want[k]) for k, h in enumerate(hosts)) <= url_filters.MARGIN
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(x) for x in pages])
    same(df.transform(url_filters.judge_urls).select("page_id", "host", "path", "rule", "verdict"), [tuple(r) for r in con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filters.OP10_SQL})").fetchall()])
