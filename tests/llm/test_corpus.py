"""SimHash, decontamination, language-model scoring and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bucketlane.llm import decontam, entries, lm, runtime, simhash
from tests.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _classes(fps):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(docs)
    fps = [_print(docs[i]) for i in ids]
    least: dict = {}
    for i, c in zip(ids, _classes(fps)):
        least.setdefault(c, i)
    rows = {r.doc_id: r for r in entries.op6_simhash(spark, SMALL).collect()}
    assert set(rows) == set(ids)
    for i, f, c in zip(ids, fps, _classes(fps)):
        assert rows[i].fingerprint == f"{f:016x}" and rows[i].component_id == least[c]


@pytest.mark.parametrize("most", [4096, 60])
def test_links_keep_all_classes(spark, most):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)} | {0, 1, 7, 15}
    x = rng.getrandbits(64)
    for _ in range(30):  # a chain
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.add(x)
    fps = sorted(fps)
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame(pd.DataFrame({"fp": [sign(f) for f in fps]}))
    root = {r.node: r.root for r in simhash.components(simhash.links(df, 3, most)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f, c in zip(fps, _classes(fps)):
        got[root.get(sign(f), sign(f))].add(f)
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(map(sign, v)) for k, v in got.items())


def test_simhash_edges(spark):
    df = spark.createDataFrame([(5, None), (4, ""), (3, " \n\t"), (7, "a"), (7, "A"), (None, "b c"), (8, "word " * 50000)], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 7 and {r.component_id for r in got if r.fp == 0} == {3}
    assert sorted(r.component_id for r in got if r.doc_id == 7) == [7, 7] and [r.component_id for r in got if r.doc_id is None] == [None]
    wide = df.selectExpr("*", "1 as fp", "2 as component_id")
    kept = simhash.representatives(wide).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 7), (False, 8), (True, 0)] and kept[0].asDict().keys() == set(wide.columns)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_representatives_of_null_and_reused_ids(spark):
    """One row of each class, whatever the ids: equal ids of different texts stay, null ids count last within their class."""
    rows = [(None, "one two three"), (None, "four five six"), (None, "Four five  six"), (7, "seven eight nine"), (7, "ten eleven twelve"), (7, "TEN eleven twelve"), (None, "seven eight nine")]
    for some in (rows, rows[:3], rows[:4]):
        df = spark.createDataFrame(some, "doc_id long, text string").withColumn("fp", F.lit("x"))
        out = simhash.representatives(df)
        assert out.columns == df.columns
        got = sorted((str(r.doc_id), " ".join(r.text.lower().split())) for r in out.collect())
        want = [("7", "seven eight nine"), ("7", "ten eleven twelve"), ("None", "four five six"), ("None", "one two three")]
        assert got == [w for w in want if w[0] == "None" or any(r[0] == 7 and r[1].lower() == w[1] for r in some)]


# -- decontamination -------------------------------------------------------
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _hits(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[s : s + n])].add(i)
    out = []
    for t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    ids |= wins[k]
                    hit |= set(range(s, s + n))
        out.append((len(w), len(hit), ids))
    return out


def test_decontamination_both_ways(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    first = bench.first().text
    more = [(1000, None), (1001, ""), (1002, first), (1003, " ".join(first.split()[:9])), (1004, "Of The x é"), (1004, first.upper()), (1005, None), (1005, "zz zz zz")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(3)
    extra = [(900, "of the"), (901, "zz"), (902, None), (903, "!! --"), (None, first), (904, "x É"), (904, "x É")]
    bench = bench.select("item_id", "text").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    rows = docs.collect()
    want = sorted((r.doc_id, n, h, len(i - {None}), decontam.items_digest(i), h > 0) for r, (n, h, i) in zip(rows, _hits([r.text for r in rows], [tuple(r) for r in bench.collect()])))
    for most in (decontam.MOST, 0):
        assert sorted(tuple(r) for r in decontam.mark(docs, bench, most=most).collect()) == want
        kept = decontam.clean(docs, bench, most=most)
        assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_winnowing_guarantee():
    rng = random.Random(4)
    for _ in range(200):
        shared = [rng.choice("abcdefgh") for _ in range(10)]
        side = lambda: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        texts = [" ".join(side() + shared + side()) for _ in range(2)]
        kept = []
        for t in texts:
            w = decontam.scan(*runtime.strings(pa.array([t])))
            h, valid = decontam.bytewords.grams(w.hash, w.doc, 5)
            at = decontam.winnow(h, valid, 6)
            kept.append(set(h[at].tolist()))
        assert kept[0] & kept[1]


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.mark(docs, none).collect()] == [0, 0] and decontam.mark(docs.limit(0), none).count() == 0
    assert decontam.mark(docs, none, most=-1).count() == 2


# -- language model --------------------------------------------------------
def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def _brute(train, texts, order=2):
    """Interpolated modified Kneser-Ney by its definition, with dictionaries."""
    words, counts = Counter(), {k: Counter() for k in range(1, order + 1)}
    for t in train:
        seq = _tokens(t)
        words.update(seq)
        whole = ["<s>", *seq]
        counts[order].update(tuple(whole[i : i + order]) for i in range(len(whole) - order + 1))
        for k in range(2, order):  # what begins a text keeps its count
            counts[k].update([tuple(whole[:k])] * (len(whole) >= k))
    for k in range(order, 1, -1):
        counts[k - 1].update(g[1:] for g in counts[k])
    tally = lambda xs: lm.discounts(*(sum(x == i for x in xs) for i in (1, 2, 3, 4)))
    d = {k: tally(list(c.values())) for k, c in counts.items()}
    after = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]][0] += n
            after[k][g[:-1]][min(n, 3)] += 1
    n, v = sum(words.values()), len(words)

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (v + 1)
        total, *kinds = after[len(g)].get(g[:-1], [0, 0, 0, 0])
        if not total:
            return lower
        c, ds = counts[len(g)].get(g, 0), d[len(g)]
        return (c - ds[min(c, 3)]) / total + sum(ds[i + 1] * kinds[i] for i in range(3)) / total * lower

    out = []
    for t in texts:
        seq = _tokens(t)
        whole = ["<s>", *seq]
        score = sum(math.log10(p(tuple(whole[max(0, i - order + 1) : i + 1]))) for i in range(1, len(whole)))
        out.append((len(seq), sum(words[w] > 0 for w in seq), sum(math.log10((words[w] + 1) / (n + v + 1)) for w in seq), score))
    one = [sum(p((*h, w)) for w in words) + p((*h, "never seen")) for h in (("<s>",), ("the",), ("never seen either",), ("of", "the")[: order - 1])]
    return n, out, one


def test_lm_query_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)
    out = lambda r: zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    n, want, one = _brute([r.text for r in docs if not out(r)], [r.text for r in docs])
    assert all(abs(x - 1) < 1e-9 for x in one)
    rows = sorted(entries.op4_lm(spark, SMALL).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(docs)
    for d, r, (k, known, base, score) in zip(docs, rows, want):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(d), k, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_orders(spark, monkeypatch, order):
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect(), key=lambda r: r.doc_id)
    n, want, one = _brute([r.text for r in docs[::2]], [r.text for r in docs], order)
    assert all(abs(x - 1) < 1e-9 for x in one)
    monkeypatch.setattr(lm, "RANGE", 3000)  # many ranges, hot contexts dealt on their own
    df = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string")
    model = lm.train(spark.createDataFrame([(r.text,) for r in docs[::2]], "text string"), order=order)
    assert len(model.hot) > 1 and len(model.discounts) == order
    for r, w in zip(lm.score(df, model).orderBy("doc_id").collect(), want):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w[0], w[1], n) and math.isclose(r.score, w[3], rel_tol=1e-9)


def test_lm_edges(spark, monkeypatch):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a b a b"), (2, "a b a b"), (3, "x " * 30000)], "doc_id long, text string")
    monkeypatch.setattr(lm, "RANGE", 100)  # many ranges, hot words dealt on their own
    model = lm.train(df.select("text"))
    assert len(model.hot) > 1 and model.n_tokens == 5 + 8 + 30000
    _, want, _ = _brute([r.text for r in df.collect()], [r.text for r in df.collect()])
    got = sorted((r.n_tokens, round(r.score, 6)) for r in lm.score(df, model).collect())
    assert got == sorted((w[0], round(w[3], 6)) for w in want)
    none = lm.train(df.limit(0).select("text"))
    assert {(r.base_score, r.score, r.n_known) for r in lm.score(df, none).collect()} == {(0.0, 0.0, 0)}
    with pytest.raises(ValueError):
        lm.folder_of(spark, "hdfs://somewhere/else")


# -- pipeline --------------------------------------------------------------
def test_stages_without_labels_or_languages(spark, tmp_path):
    """Documents of which none has a label, a language or a benchmark item pass all stages; texts without letters don't."""
    import corpus_pipeline

    rows = [(i, f"some words of document number {'abcdefghij'[i]} that nobody has seen", None, None, 40, "x") for i in range(8)] + [(8, "1 2 3", None, None, 5, "x"), (9, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    spark.createDataFrame([(77, 1, 0), (None, 0, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    got = docs.collect()
    assert 0 < len(got) <= 8 and all(r.n_tokens == len(r.token_ids) > 0 and r.row == "x" for r in got)
    empty = docs.limit(0).drop("token_ids", "n_tokens")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_inner_names_of_stages(spark):
    names = ["row", "row_", "n", "__row", "__kept", "kept", "fp", "component_id", "text_"]
    rows = [(i, f"words {'one two three four five six'.split()[i % 3]} and more of the same kind {i % 3}", *names) for i in (1, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    bench = spark.createDataFrame([(1, "never seen words in this order at all by anyone ever")], "item_id long, text string")
    for out in (simhash.representatives(df), simhash.representatives(df.where("doc_id > 1")), decontam.clean(df, bench), decontam.clean(df, bench, most=-1)):
        assert out.columns == df.columns and all([r[n] for n in names] == names for r in out.collect()) and out.count()


def test_rows_of_one_id_are_told_apart(spark):
    """Different documents that share an id, or have none, all stay; of copies one does."""
    far = ["alpha beta gamma delta", "one two three four five", "red green blue black", "north south east west wind", "cat dog cow horse"]
    df = spark.createDataFrame([(None, far[0]), (None, far[1]), (None, far[2]), (5, far[3]), (5, far[4])], "doc_id long, text string")
    assert simhash.representatives(df).count() == 5
    df = spark.createDataFrame([(1, far[0]), (5, far[0]), (5, far[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.representatives(df).collect()) == [(1, far[0]), (5, far[1])]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "doc_id as score", "'x' as fp")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = runtime.checkpoint(stage(spark, docs, SMALL))
        assert docs.count() <= before and docs.columns[: len(columns)] == columns, name
    assert docs.columns == [*columns, "token_ids", "n_tokens"]
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    rows = {r.doc_id: r for r in entries.op6_simhash(spark, SMALL).collect()}
    assert len({rows[i].component_id for i in kept}) == len(kept)
    marks = {r.doc_id: r.contaminated for r in entries.op9_decontam(spark, SMALL).collect()}
    assert not any(marks[i] for i in kept) and len(kept) > 0.5 * len(rows)


def test_pipeline_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"
    odd = spark.createDataFrame([(1, None, None, None, None, "a"), (1, "", "en", "s", 0, "b"), (None, "the and of to in that", "en", "s", 5, "c"), (2, "the and of to in it", "en", None, 5, "d"), (2, "the and of to in it", "en", None, 5, "d")], schema)
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = runtime.checkpoint(stage(spark, docs, SMALL))
        assert docs.count() <= rows.count() and set(docs.columns) == {*odd.columns, "token_ids"}
