"""Fill-in-middle, mixing and spelling variants against brute force on small tables."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planemark.llm import fill_in, mixing, ngram_join, spelling, suffixes
from planemark.llm.common import shared_dir
from planemark.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, source string, size string, copies int, word string, n long, target string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 9, "w", 1, "t") for i, t, s in rows], SCHEMA).repartition(3)


def in_sql(con_rows, query):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in con_rows])
    out = con.sql(query)
    return out.columns, out.fetchall()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    stems = ["".join(rng.choices("abcdeéß", k=rng.randint(5, 12))) for _ in range(60)]
    stems += [s[:k] + rng.choice(["", "a", "éb"]) + s[k + 1 :] for s in stems for k in (0, len(s) // 2, len(s) - 1)]
    make = lambda n: "".join(rng.choice(stems).title() + rng.choice([" ", "\n", "\r\n", ", ", "  "]) for _ in range(n))
    out = [(k, make(rng.choice([3, 40, 200])), rng.choice(["a", "b", "c", "é", None, "big", "big", "big"])) for k in range(60)]
    odd = ["", None, "x" * 40_000, make(6000), "<P> and <S>", "a<M>", " ", "\U0001f468‍\U0001f469 é\x00 \r\n" * 3, "tail <", "> head", "<S<", "P>"]
    out += [(100 + k, t, "odd") for k, t in enumerate(odd)] + [(200, None, "void"), (201, "", "void"), (None, make(20), "a"), (None, None, None), (3, out[3][1], out[3][2]), (3, out[3][1], out[3][2])]
    return out


def filled(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def test_op11_against_brute_force(spark, rows):
    got = fill_in.restored(fill_in.fill_in_middle(table(spark, rows))).collect()
    want = collections.Counter((i, *filled(i, t), t or "") for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in.fill_in_middle(table(spark, rows).limit(0)).collect() == []


def test_op11_every_cut_is_restored(spark):
    """All pairs of ids and texts that hold parts of marks."""
    rng = random.Random(1)
    pieces = ["<", "P", "S", "M", ">", "<P", "S>", "<M", " ", "é"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randint(1, 12))), None) for k in range(800)]
    got = fill_in.restored(fill_in.fill_in_middle(table(spark, rows), plain_from=101, spm_below=50))
    assert got.where("restored <> output AND form = 'plain'").isEmpty()
    assert {r.doc_id: r.restored for r in got.collect()} == {i: t for i, t, _ in rows}


def test_offsets_are_those_of_the_whole_text():
    from tokenizers import Regex, pre_tokenizers

    text = "é \r\n\n  " + "y" * 100 + " \U0010ffff\U0001f468‍\U0001f469 end"
    whole = [a for _, (a, _) in pre_tokenizers.Split(Regex(r"[\s\S]"), "isolated").pre_tokenize_str(text)]
    ranked = fill_in.Offsets().of_text(text)
    assert [ranked.at(k) for k in range(len(ranked))] == whole == list(range(len(text))) and ranked.at(len(ranked)) == len(text)


def test_op11_and_op12_against_sql(spark, sf, rows):
    for name in ("op11_fill_in_middle", "op12_mixing"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        got = QUERIES[name](spark, sf)
        want = con.sql(SQL[name])
        assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    docs = table(spark, rows).withColumn("size", mixing.count_words(F.col("text")))
    columns, want = in_sql(rows, SQL["op12_mixing"])
    got = mixing.mix_sources(docs).withColumn("taken", F.col("copies") * F.col("size")).select(*columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def shared_out(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop what is over, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        unit = left / sum(w[s] for s in open_)
        for s in open_:
            target[s] += unit * w[s]
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.remove(s)
    return target


def test_op12_targets_and_copies(spark, rows):
    out = mixing.mix_sources(table(spark, rows).withColumn("size", mixing.count_words(F.col("text")))).collect()
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in out:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.size == size and 0 <= r.copies <= 3
        sizes[r.source] += size
        taken[r.source] += r.copies * size
        largest[r.source] = max(largest[r.source], size)
    want = shared_out(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes) and abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_op12_reruns_and_emission(spark, rows):
    docs = table(spark, rows).withColumn("size", mixing.count_words(F.col("text")))
    a, b = mixing.mix_sources(docs), mixing.mix_sources(docs.repartition(7).orderBy("text"))
    key = lambda r: (repr(r.doc_id), r.size, r.copies)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert mixing.emitted(a).count() == a.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert {r.copies for r in mixing.mix_sources(docs.where("source = 'void'")).collect()} == {0}
    others = mixing.mix_sources(docs, seed=5).collect()
    assert sorted(map(key, others)) != sorted(map(key, a.collect()))


def test_op12_a_source_of_one_size(spark):
    """Without differences in size the copies alone carry the target."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"), F.lit(7).alias("size"))
    out = mixing.mix_sources(docs, weights=(1, 3)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 7 for r in out) and {r.source: r.most for r in out} == {"a": 1, "b": 3}


RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def neighbours(word, words):
    letters = {c for w in words for c in w}
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return (made & words.keys()) - {word}


def grouped(words):
    near = {w: neighbours(w, words) for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), form[w] and words[form[w]]))
    return out


@pytest.fixture(scope="module")
def many_words():
    """Chains of forms, one hot half, long words, doubled letters, and words below the limits."""
    rng = random.Random(3)
    words = {}
    for _ in range(150):
        w, n = "".join(rng.choices("abcé", k=rng.randint(6, 10))), rng.choice([5, 6, 30, 700])
        for _ in range(rng.randint(1, 5)):
            words[w] = n
            k = rng.randrange(len(w))
            w, n = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdÿ") + w[k:], w[:k] + rng.choice("xyzé") + w[k + 1 :]]), max(5, n // rng.choice([2, 5, 6]))
    words |= {"common" + "".join(rng.choices("abc", k=6)): rng.choice([5, 25, 200]) for _ in range(120)}
    words |= {"".join(rng.choices("abc", k=4)) + "commonest": rng.choice([5, 25, 200]) for _ in range(60)}
    words |= {"q" * k: 5 * k for k in range(6, 12)} | {"z" * 300: 5, "z" * 299: 50, "z" * 150 + "y" + "z" * 149: 500}
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize("hot", [None, 8])
@pytest.mark.parametrize("shard_words", [10_000, 60])
def test_op13_against_brute_force(spark, many_words, monkeypatch, hot, shard_words):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(spelling, "HOT", hot or spelling.HOT)
    monkeypatch.setattr(spelling, "PAIRS", 64)
    df = spark.createDataFrame(list(many_words.items()), "word string, n long").repartition(3)
    got = spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(many_words) and {tuple(r) for r in got} == grouped(many_words)


def test_op13_words_of_documents(spark, rows, sf, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 50)
    got = {r.word: r.n for r in spelling.word_counts(table(spark, rows)).collect()}
    assert got == counted([(i, t) for i, t, _ in rows]) and got
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = counted(docs)
    assert {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).collect()} == grouped(want) and len(want) > 500
    assert spelling.spelling_variants(spelling.word_counts(table(spark, rows).limit(0))).collect() == []


def test_passages_of_short_words_and_whole_words(spark):
    """51 words of one or two letters are a passage, and 49 words between torn ones are none."""
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    short = " ".join(rng.choice(["a", "b", "c", "de"]) for _ in range(51))
    torn = make(49)
    rows = [(1, f"{make(9)} {short} {make(3)}"), (2, f"{short}\n{make(5)}"), (3, f"{make(4)} preone {torn} zone {make(2)}"), (4, f"{make(3)} paeone {torn} zonf"), (5, make(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    out = {r.doc_id: r.text for r in corpus_pipeline.passage_stage(spark, df, "").collect()}
    assert short not in out[1] and short not in out[2] and out[1].split() == rows[0][1].replace(short, "").split()
    assert [out[k] for k in (3, 4, 5)] == [t for i, t in rows if i in (3, 4, 5)]


def leftovers(spark):
    """Kinds of tables in the shared folder, with their number."""
    folder = shared_dir(spark).removeprefix("file:")
    return collections.Counter(x.rsplit("-", 1)[0] for x in os.listdir(folder)) if os.path.isdir(folder) else collections.Counter()


def test_sets_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """Fifty texts of one passage and some words of their own are not similar, which their numbers tell; their pairs are not listed, and
    tables with a number a token do not stay."""
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, listed, verified = make(60), [], ngram_join._verified
    rows = [(i, " ".join(passage + make(9))) for i in range(50)]
    rows += [(50, rows[0][1] + " more"), (51, " ".join(make(70)))]

    def counted(pairs, *more):
        listed.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    before = leftovers(spark)
    out = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: 0 if i == 50 else i for i in range(52)}
    assert len(listed) == 4 and listed[-1] < 50
    assert not {"sets", "representatives", "keyed", "differences"} & set(leftovers(spark) - before)


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_keep_similar_pairs(spark, percent):
    rng = random.Random(percent)
    sets = []
    for n in [1, 5, 9, 10, 18, 40, 90, 300]:
        base = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        for most in {0, 1, n * (100 - percent) // (100 + percent), n * (100 - percent) // 100, n // 2}:
            sets += [set(base[most:]), set(base[most:]) | {rng.randrange(-(2**63), 2**63) for _ in range(most)}]
    df = collections.Counter(x for s in sets for x in s)
    rows = [(i, len(s), sum(df[x] > 1 for x in s), [x for x in s if df[x] > 1]) for i, s in enumerate(sets)]
    shaped = spark.createDataFrame(rows, "id long, n long, n_shared long, tokens array<long>").select("id", "n", ngram_join._shape().alias("shape")).coalesce(1).localCheckpoint()
    other = shaped.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shape").alias("shape_b"))
    passed = {(r.id, r.b) for r in shaped.crossJoin(other).where("id < b").where(ngram_join._may_link(percent)).select("id", "b").collect()}
    similar = {(a, b) for b, t in enumerate(sets) for a, s in enumerate(sets[:b]) if s and 100 * len(s & t) >= percent * len(s | t)}
    assert similar <= passed and len(similar) > 40 and len(passed) < 300 < len(sets) ** 2 / 8


def test_segments_that_stand_once_are_dropped(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    again, kept, classes = make(500), [], suffixes._classes

    def counted(segments):
        kept.append({r.row_id for r in segments.select("row_id").distinct().collect()})
        return classes(segments)

    monkeypatch.setattr(suffixes, "_classes", counted)
    df = spark.createDataFrame([(1, make(900)), (2, make(300) + again), (3, again + make(50)), (4, make(2000))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffixes.repeated_bytes(df, 400).collect()} == {1: 0, 2: 500, 3: 500, 4: 0}
    assert kept == [{2, 3}]
