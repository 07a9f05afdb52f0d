"""Language ID, quality, chat, licences, pages and media: fixtures against brute force, round trips and held-out accuracy."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketlane.llm import chat, entries, langid, licences, media, pages, quality
from tests.conftest import MEDIUM, SMALL

LARGE = "/root/testdata/sf0.1"



# -- language ID -----------------------------------------------------------
def test_forward_backward_equals_brute_force():
    rng = np.random.default_rng(0)
    scores, t, first = rng.normal(size=(300, 3)), rng.normal(size=(3, 3)), np.array([0, 5, 5, 135, 300])
    got = langid.posteriors(first, scores, t)
    for a, b in zip(first[:-1], first[1:]):
        x, y, alpha, beta = np.ones(3), np.ones(3), [], []
        for i in range(a, b):
            x = (x @ np.exp(t)) * np.exp(scores[i])
            x /= x.sum()
            alpha.append(x)
        for i in range(b - 1, a - 1, -1):
            beta.append(y)
            y = np.exp(t) @ (y * np.exp(scores[i]))
            y /= y.sum()
        want = np.array(alpha) * np.array(beta[::-1]) if b > a else np.zeros((0, 3))
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_parts_of_long_texts(spark, monkeypatch):
    """A text that goes through in parts has the posteriors of one pass."""
    model = langid.fit(["the and of to was with", "der die das und nicht mit"], ["en", "de"])
    text = " ".join(np.random.default_rng(3).choice(["the", "und", "x", "mit", "was", "12", "die"], 9000))
    t, scores = langid._scores(model, [text])
    whole = langid.posteriors(t.first, scores, model.transitions)
    monkeypatch.setattr(langid, "CHUNK", 1 << 12)
    parts = list(langid._by_part(model, text))
    assert len(parts) > 5 and np.allclose(np.concatenate(parts[::-1]), whole)
    (lang, score), best = langid.predict(model, [text])[0], whole.mean(0)
    assert lang == model.langs[int(best.argmax())] and abs(score - best.max()) < 1e-9
    assert langid.predict(model, ["1 2 " * 9000]) == [("und", 0.0)] and [x for _, x in langid.label_words(model, text)] == [model.langs[i] for i in whole.argmax(1)]


def test_excerpts_come_from_all_over_a_text():
    text = " ".join(f"w{i:05d}" for i in range(20_000))
    got = langid.excerpts(text)
    seen = [int(w[1:]) for w in got.split()]
    assert len(got) < 2 * langid.EXCERPT and set(got.split()) <= set(text.split()) and seen == sorted(seen)
    assert min(seen) < 2000 and max(seen) > 18_000 and langid.excerpts("a b") == "a b" and set(langid.excerpts("x" * 9000)) == {"x", "\n"}


def test_many_languages(spark):
    """More languages than weights allow with all bits, and one row of each."""
    names = [f"l{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abcdefgh"), n) for i, n in enumerate(names)], "text string, lang string")
    model = langid.train(df)
    assert model.langs == sorted(names) and len(model.weights) * 300 <= langid.MOST_WEIGHTS
    rows = df.collect()
    assert np.mean([langid.predict(model, [r.text])[0][0] == r.lang for r in rows[:40]]) > 0.9


def _op1_brute(docs, model):
    """Each word's posteriors by forward-backward over the whole text, one word at a time."""
    out = {}
    for r in docs:
        t, scores = langid._scores(model, [r.text])
        if not len(t.form):
            out[r.doc_id] = ("und", 0.0)
            continue
        e, a = np.exp(scores - scores.max(1, keepdims=True)), np.exp(model.transitions - model.transitions.max())
        f, b = np.empty_like(e), np.empty_like(e)
        x = y = np.full(len(model.langs), 1 / len(model.langs))
        for i in range(len(e)):
            x = (x @ a) * e[i]
            x = f[i] = x / x.sum()
        for i in range(len(e) - 1, -1, -1):
            b[i] = y
            y = a @ (y * e[i])
            y = y / y.sum()
        p = f * b
        mean = (p / p.sum(1, keepdims=True)).mean(0)
        out[r.doc_id] = (model.langs[int(mean.argmax())], float(mean.max()))
    return out


def test_langid_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = _op1_brute(docs.collect(), entries.language_model(docs))
    rows = entries.op1_langid(spark, SMALL).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6


def test_langid_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = entries.op1_langid(spark, MEDIUM).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


def test_code_switching(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = entries.language_model(docs)
    got = langid.label_words(model, "the and with from der die nicht und que les dans pour")
    assert [x for _, x in got[:4]] == ["en"] * 4 and [x for _, x in got[4:8]] == ["de"] * 4 and [x for _, x in got[9:]] == ["fr"] * 3


def test_langid_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "the and of", None), (3, "the and of", None), (None, "", "q")], "doc_id long, text string, lang string")
    model = langid.fit(["the and of to", "der die das und"], ["en", "de"])
    got = langid.identify(df.withColumn("score", F.lit("x")), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == ["und", "und", "en", "en", "und"]
    assert langid.identify(df, langid.train(df.limit(0))).where("lang_pred != 'und'").count() == 0
    assert langid.keep_identified(df, model).columns == df.columns


# -- quality ---------------------------------------------------------------
def test_quality_query(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = entries.op3_quality(spark, MEDIUM).collect()
    assert len(rows) == docs.count()
    seen = [(r.accepted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean([a == bool(y) for a, y in seen]) > 0.98
    assert np.mean([a for a, y in seen if y]) > 0.99


def test_quality_on_held_out_labels(spark):
    """Labels of a quarter of the documents take no part in training."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 4 != 1"))
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 1").collect()}
    seen = [(r, held[r.doc_id]) for r in quality.score(docs, model).collect() if r.doc_id in held]
    assert np.mean([r.accepted == bool(y) for r, y in seen]) > 0.98
    assert np.mean([r.accepted for r, y in seen if y]) > 0.99
    assert abs(np.mean([r.quality_score for r, _ in seen]) - np.mean([y for _, y in seen])) < 0.02  # calibrated


def test_quality_query_against_brute_force(spark):
    """The whole query, against co-training over rows in memory."""
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect(), {r.doc_id: float(r.quality > 0) for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect() if r.quality is not None}
    data, offsets = quality.strings(quality.pa.array([r.text for r in docs], quality.pa.string()))
    a, m = quality.content(data, offsets), quality.metadata([r.source for r in docs], [r.lang for r in docs], [r.n_chars for r in docs])
    prints, y = quality.prints_of(a, m), np.array([labels.get(r.doc_id, np.nan) for r in docs])
    told = np.flatnonzero(~np.isnan(y))
    told, free = told[np.unique(np.column_stack([prints[told], y[told].astype(np.int64)]), axis=0, return_index=True)[1]], np.flatnonzero(np.isnan(y))
    assert len(free) > 300
    model = quality.cotrain((a[told], quality.widened(m)[told]), y[told], quality.from_arrays(a[free], m[free]), min(quality.GIVEN, len(free) // 10))
    want = dict(zip([r.doc_id for r in docs], model.scores(a, quality.widened(m)).tolist()))
    rows = entries.op3_quality(spark, MEDIUM).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert np.allclose([r.quality_score, r.content_score, r.metadata_score], want[r.doc_id], atol=1e-6) and r.accepted == (r.quality_score >= 0.5)


def test_ties_and_copies_among_the_surest(spark):
    """Rows of equal features are given once, ties go by hash; the table gives what the arrays give."""
    rng = np.random.default_rng(2)
    a, m = np.repeat(rng.random((40, quality.N_CONTENT)), 5, 0).astype(np.float16).astype(float), np.repeat(quality.metadata([f"s{i % 7}" for i in range(40)], ["x"] * 40, [9] * 40), 5, 0)
    models = [quality.logistic(f[::5], np.arange(40) % 2.0) for f in (a, quality.widened(m))]
    packed = [x.to_pylist() for x in quality._packed(a, m)]
    table = spark.createDataFrame(list(zip(*packed, quality.prints_of(a, m).tolist())), "a binary, m binary, print long").repartition(5)
    one, two = quality.from_arrays(a, m), quality.from_table(table)
    for _ in range(3):
        for (x, y), (u, w) in zip(one(models, 4, 6), two(models, 4, 6)):
            for p, q in ((x, u), (y, w)):
                assert all((i == j).all() for i, j in zip(p, q)) and len(np.unique(p[0], axis=0)) == len(p[0])


def test_cotraining_helps_the_weak_view_and_holds_out():
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.7).astype(float)
    a, b = (y[:, None] * 2 + rng.normal(size=(2000, 3)) for _ in range(2))
    few = slice(0, 120)
    model = quality.cotrain((a[few], b[few]), y[few], quality.from_arrays(a[120:1500], b[120:1500], b[120:1500]), 138)
    p = model.scores(a[1500:], b[1500:])
    assert ((p[:, 0] >= 0.5) == y[1500:]).mean() > 0.93
    assert abs(p[:, 1].mean() - y[1500:].mean()) < 0.1  # calibrated


def test_quality_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string"
    docs = spark.createDataFrame([(1, None, None, None, None, "z"), (1, "", "en", "s", 0, "z"), (None, "a b\n" * 30000, "en", "s", -4, "z")], schema)
    none = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r.quality_score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.keep_good(docs, model).columns == docs.columns and quality.keep_good(docs.limit(0), model).count() == 0


# -- chat ------------------------------------------------------------------
def test_layouts():
    records = [
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": None, "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
        ({"data": {"messages": [{"author": {"role": "user"}, "content": {"parts": ["a", "b"]}}]}}, "nested_messages", [("user", "a\nb")]),
        ({"role": "user", "text": None}, "turn", [("user", "")]),
        ({"something": 1}, None, []),
    ]
    prints = {}
    for record, name, want in records:
        print_, m = chat.mapping(record)
        assert (m and m.name) == name and (chat.turns(record, m) if m else []) == want
        prints[print_] = name
    assert len(prints) == len(records)


def test_fields_that_no_mapping_reads():
    said, turns = [{"from": "human", "value": "a", "source": "s"}, {"from": "gpt", "value": "b"}], [("user", "a"), ("assistant", "b")]
    records = [
        ({"id": "x", "conversations": said}, "conversations", turns),
        ({"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "source": "s"}, "messages", turns),
        ({"id": 1, "instruction": "a", "output": "b", "category": "c", "text": "a b"}, "instruction", turns),
        ({"prompt": "a", "completion": "b", "response": "c"}, None, []),
        ({"prompt": "a", "completion": "b", "conversations": said}, None, []),
        ({"role": "user", "text": "a", "id": 4}, "turn", [("user", "a")]),
    ]
    for record, name, want in records:
        m = chat.mapping(record)[1]
        assert (m and m.name) == name and (chat.turns(record, m) if m else []) == want


def test_escaping_is_reversible():
    for text in ("<|im_end|>", "<\\|x", "<\\\\|", "a<b|c", "<<||", "\\<|", "<|im_end|>\n<|im_start|>assistant\nx", ""):
        for role in ("user", "a\nb", "a\\nb", "<|im_start|>", "\\"):
            marked, span = chat.write_turn(role, text)
            assert chat.read_turn(marked) == (role, text) and marked.count("<|") == 2
            assert list(chat.split_turns(marked * 3)) == [marked] * 3 and span is None
    marked, (a, b) = chat.write_turn("assistant", "<|x")
    assert chat.unescape(marked[a:b]) == "<|x"


def test_chat_query(spark):
    want: dict = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in sorted(spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), key=lambda r: r.turn):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    rows = {r.conv_id: r for r in entries.op5_chat(spark, SMALL).collect()}
    assert set(rows) == set(want)
    for k, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert rows[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (rows[k].n_turns, rows[k].loss_chars, rows[k].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert rows[k].formatted_chars == sum(len(chat.write_turn(*t)[0]) for t in turns)


def test_chat_edges(spark):
    df = spark.createDataFrame([(1, 0, None, None, 5), (1, 0, None, None, 5), (1, None, "user", "x", 5), (None, 1, "user", "y", 5)], "conv_id long, turn long, role string, text string, formatted long")
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and chat.conversations(df.limit(0)).count() == 0
    j = spark.createDataFrame([("{", 1), (None, 2), (json.dumps({"prompt": "p", "response": "r"}), 3)], "record string, layout int")
    out = chat.format_records(j, "record").collect()
    assert [r.layout for r in out] == [None, None, "prompt_response"] and out[2].loss_spans[0].start < out[2].loss_spans[0].end


# -- licences --------------------------------------------------------------
def _names(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.licences for r in licences.scan(df).orderBy("doc_id").collect()]


def test_licence_rules(spark):
    s = licences.SENTENCES
    mit = "\n".join(s[k] for k in ("MIT-GRANT", "MIT-NOTICE", "MIT-ASIS", "MIT-LIABLE"))
    wrapped = re.sub(r"(.{50,70}?) ", r"\1\n", mit.replace("\n", " "))
    bsd = [s[k] for k in ("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES", "BSD-ASIS")]
    got = _names(spark, None, "", "No licence here.", mit, f"Intro text.\n\n{wrapped}\n\nMore.", " ".join(bsd), " ".join(bsd[:3] + bsd[4:]), "SPDX-License-Identifier: Apache-2.0", "x\nLicensed under CC BY-NC 4.0.\ny\nReleased under the MIT License.", s["MPL-FORM"], s["MIT-NOTICE"], "licensed  under the\tAPACHE LICENSE, version 2.0.")
    assert got == ["", "", "", "MIT", "MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "CC-BY-NC-4.0,MIT", "MPL-2.0", "", "Apache-2.0"]


def test_each_known_sentence_is_found(spark):
    ids = sorted(licences.SENTENCES)
    df = spark.createDataFrame([(i, licences.SENTENCES[k]) for i, k in enumerate(ids)], "doc_id long, text string")
    rules = {}
    for name, ids_ in licences.RULES:
        if len(ids_) == 1:
            rules.setdefault(ids_[0], name)
    for r in licences.scan(df).collect():
        assert r.sentence_ids.split(",") == [licences.KNOWN[w] for w in licences._words_of(licences.SENTENCES[ids[r.doc_id]])]
        assert rules.get(ids[r.doc_id], "") in r.licences.split(",")


def test_holders_and_tags(spark):
    s = licences.SENTENCES
    names = s["BSD-NAMES"].replace("the copyright holder", "Example Labs, Inc.")
    asis = s["BSD-ASIS"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "EXAMPLE LABS ``AND''")
    bsd = [s["BSD-HEAD"], s["BSD-SOURCE"], s["BSD-BINARY"], names, asis]
    tags = [f"SPDX-License-Identifier: {t}" for t in ("GPL-3.0-or-later", "LGPL-2.1-only", "AGPL-3.0", "CC-BY-SA-4.0", "Zlib")]
    got = _names(spark, "\n".join(bsd), "// " + "\n# ".join(tags), "This work is licensed under a Creative Commons Attribution 4.0 International License.", "\n".join([s["ZLIB-ASIS"], s["ZLIB-LIABLE"], s["ZLIB-GRANT"]]), s["EUPL-LINE"], s["0BSD-GRANT"] + "\n" + s["ISC-ASIS"])
    assert got == ["BSD-3-Clause", "AGPL-3.0,CC-BY-SA-4.0,GPL-3.0-or-later,LGPL-2.1-only,Zlib", "CC-BY-4.0", "Zlib", "EUPL-1.2", "0BSD"]


def test_own_columns_of_any_name(spark):
    """Columns that are named like what operators use inside stay."""
    names = ["lines", "paras", "names", "row", "stored", "made", "__row", "__lines", "n"]
    df = spark.createDataFrame([(1, "Released under the MIT License.", json.dumps({"role": "user", "text": "a"}), *names)], ["doc_id", "text", "record", *names])
    for out in (licences.scan(df), media.store(df), chat.format_records(df, "record"), langid.keep_identified(df, langid.fit(["the of", "der die"], ["en", "de"]), least=0.0)):
        row = out.first()
        assert [row[n] for n in names] == names and set(df.columns) <= set(out.columns)


def test_licence_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.\nReleased under the MIT License.", "own")], "doc_id long, text string, licences string")
    row = licences.scan(df).first()
    assert row.licences == "MIT" and row.n_sentences == 2 and licences.scan(df.limit(0)).count() == 0
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- pages -----------------------------------------------------------------
def test_pages_query(spark):
    docs = {" ".join(r.text.split()) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = entries.op7_pages(spark, MEDIUM).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    assert len(rows) == len(html) and all(r.n_chars == len(r.text) for r in rows)
    whole = 0
    for r in rows:
        title = " ".join(pages._html.unescape(re.search("<h1>(.*?)</h1>", html[r.page_id], re.S)[1]).split())
        assert r.text.startswith(title)
        whole += r.text[len(title) :].strip() in docs
    assert whole > 0.95 * len(rows)


def test_template_without_elements_for_main_text(spark):
    """Pages of plain div elements: what all pages of a host share is template, the rest is text."""
    page = "<html><body><div class='top'>Site Name &amp; Co</div><div><div>All rights reserved by the site</div><div id=x><p>Own text {0} of &lt;page&gt; {0}</p><p>More  words {0}<br>and lines {0}</p></div><div>Read our other stories today</div></div></body></html>"
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    for most in (pages.MOST, 0):
        for r in pages.main_text(df, most=most).collect():
            assert r.text == f"Own text {r.page_id} of <page> {r.page_id} More words {r.page_id} and lines {r.page_id}"


def test_copies_make_no_template(spark):
    """Copies count once, also where they differ in what is never content: neither alone nor beside other pages do they drop text."""
    copy = "<body><nav>menu {}</nav><div>Words of a page</div><div>that was copied</div></body>"
    rows = [(copy.format(i % 3), "https://a.example/") for i in range(6)] + [(copy.format(0), "https://b.example/")] * 9 + [(f"<body><div>Other {i}</div></body>", "https://b.example/") for i in range(4)]
    df = spark.createDataFrame([(i, u, h) for i, (h, u) in enumerate(rows)], "page_id long, url string, html string")
    got = [r.text for r in pages.main_text(df).orderBy("page_id").collect()]
    assert got == ["Words of a page that was copied"] * 15 + [f"Other {i}" for i in range(4)]


def test_template_text_within_articles(spark):
    """What all pages of a host say within their articles is template there, too; an article that is mostly shared is a copy."""
    page = "<body><article><h1>Title {0}</h1><div>Rate this story</div><p>The own text of story {0}.</p><p>{1}</p></article></body>"
    rows = [page.format(i, f"It has its own end, too: {i}.") for i in range(6)] + [page.format(i, f"It has its own end, too: {i}.") for i in range(6)]
    near = "<body><main><h1>Title</h1><p>A long story that many pages have.</p><p>Near copy {0}</p></main></body>"
    df = spark.createDataFrame([(i, "https://h.example/", r) for i, r in enumerate(rows)] + [(100 + i, "https://n.example/", near.format(i)) for i in range(6)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert [got[i] for i in range(12)] == [f"Title {i} The own text of story {i}. It has its own end, too: {i}." for i in range(6)] * 2
    assert [got[100 + i] for i in range(6)] == [f"Title A long story that many pages have. Near copy {i}" for i in range(6)]


def test_equal_vectors_share_a_class(spark):
    df = spark.createDataFrame([(f"<body><div>same</div><p>p{i}</p>{'<hr>' if i % 4 else ''}</body>", "h") for i in range(8)], "html string, host string")
    got = pages.templates(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.klass, []).append(r)
    assert len(by) == 2 and len(by[0]) == 8 and all(len(v) == 1 for k, v in by.items() if k)


def test_nesting():
    outer = {i: (0, i * 100.0) for i in range(1, 6)}
    inside, across = {10: (7, 210.0), 11: (7, 250.0)}, {20: (8, 150.0), 21: (8, 350.0)}
    assert pages.nest({**outer, **inside, **across}) == {**outer, **inside} and pages.nest({}) == {}
    by_place = {t: v for t, v in pages.settle([(t, *v, 5, 0, 0) for t, v in {**outer, **inside, **across}.items()]).items()}
    assert set(by_place) == {*outer, *inside}


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<p>a < b</p><!-- x", "a < b"), ("<article><p>One <b>two</b>three<p>Four</article>", "One twothree Four"),
    ("<main><form>no</form><p>yes&nbsp;&eacute;</p><aside>no</aside><section class='comments'>no</section></main><footer>no</footer>", "yes é"),
    ("<article>a<script>if(1<2){'</p>'}</script>b</article>", "ab"), ("<div class='cookie-notice'>no</div><div><p>text</p></div>", "text"),
    ("<div class=page><div>Menu</div><div class=body><div class=intro>First part of it.</div><div class=rest>Second part, which goes on for longer.</div></div></div>", "First part of it. Second part, which goes on for longer."),
    ("<div>x</div></div></p><p>unclosed <i>text", "x unclosed text"),
])
def test_extract(html, want):
    assert pages.extract(html, pages.ALONE) == want


@pytest.mark.parametrize("html, want", [
    ("<article><section id='discussion'><h2>Discussion</h2>We found</section><h2 id='related-work'>Related work</h2><p>More</p></article>", "Discussion We found Related work More"),
    ("<section id='legal'><h2 id='legal'>Legal</h2>text</section><div class='section' id='copyright'>terms</div><div id='footer'>no</div>", "Legal text terms"),
    ("<main><div class='entry-header'><h1>Title</h1></div>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be <object>one</object></main>", "Title Let x=1 be one"),
    ("<article>a<div class='ad'>no</div><div class='newsletter'>no</div><nav>no</nav><div role=navigation>no</div></article>", "a"),
])
def test_parts_of_articles_stay_whatever_their_names(html, want):
    assert pages.extract(html, pages.ALONE) == want


def test_names_that_the_template_has():
    html = "<article>a<div class='social'>b</div></article>"
    key = next(pages._key(k, p, t) for k, p, t, says in pages.tokens(html) if k == "<" and says == pages.NAMED)
    assert pages.extract(html, pages.ALONE) == "a b"
    assert pages.extract(html, pages.settle([(0, 0, 0.0, 20, 0, 0), (key, 0, 1.0, 2, 0, pages.NAMED)])) == "a"


def test_slots_decide(spark):
    """What the host's pages share decides what is content, not names: with an empty template, or a page's own, texts differ."""
    page = (
        "<body><div>Our site since 1999</div><ul><li><a href=1>About {1}</a><li><a href=2>Stories like {1}</a></ul><div class='banner'><p>The story {0} has many words of its own, {1}</p>"
        "<p>Shared by all pages</p></div><div>Contact us for more</div></body>"
    )
    df = spark.createDataFrame([(i, "https://h.example/", page.format(i, f"w{i * 7}")) for i in range(8)], "page_id long, url string, html string")
    for r in pages.main_text(df).collect():
        html = page.format(r.page_id, f"w{r.page_id * 7}")
        assert r.text == f"The story {r.page_id} has many words of its own, w{r.page_id * 7}"
        assert pages.extract(html, {}).startswith("Our site since 1999 About") and pages.extract(html, pages.ALONE).startswith("Our site since 1999 About")


def _brute(htmls):
    """The template of a host by explicit occurrence vectors of its different pages."""
    once = {}
    for h in sorted(htmls, key=lambda h: pages.xxhash.xxh64_intdigest(h) - (1 << 63)):
        count, said, n = pages.page_tokens(h)
        once.setdefault(said, (count, n))
    if len(once) < pages.FEWEST:
        return pages.ALONE
    vectors, rows, kinds = {}, [], {(1,) * len(once): 0}
    for i, (count, n) in enumerate(once.values()):
        for token, (times, place, chars, linked, says) in count.items():
            vectors.setdefault(token, []).append((i, times, place * 1000 // (n + 1), chars, linked, says))
    for token, seen in vectors.items():
        if len(seen) >= -(-len(once) * 6 // 10):
            v = [0] * len(once)
            for i, times, *_ in seen:
                v[i] = times
            rows.append((token, kinds.setdefault(tuple(v), len(kinds)), sum(x[2] for x in seen) / len(seen), sum(x[3] for x in seen), sum(x[4] for x in seen), max(x[5] for x in seen)))
    return pages.settle(rows)


def test_pages_query_against_brute_force(spark):
    """The whole query, against templates by explicit vectors; and the same where templates are joined."""
    table = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    by = {}
    rows = table.select("page_id", "html", pages.host_of(F.col("url")).alias("host")).collect()
    for r in rows:
        by.setdefault(r.host, []).append(r.html or "")
    made = {host: _brute(htmls) for host, htmls in by.items()}
    assert any(len(t) > 1 for t in made.values())
    want = {r.page_id: pages.extract(r.html, made[r.host]) for r in rows}
    assert {r.page_id: r.text for r in entries.op7_pages(spark, MEDIUM).collect()} == want
    for most in (0, 300):
        assert {r.page_id: r.text for r in pages.main_text(table, most=most).collect()} == want
    assert sum(want[r.page_id] != pages.extract(r.html, {}) for r in rows) > 0.9 * len(rows)


@pytest.mark.parametrize("broken", ["<a " * 40_000, "<b x='" * 20_000, "<b x=\"" * 20_001, "</a " * 40_000, "<div>" * 20_000 + "</x>" * 20_000, "<i>" * 20_000 + "<hr>" * 20_000, "<!--" * 30_000, "<script " * 20_000, "<script>" * 20_000, "< " * 60_000, "<p" * 60_000, "<![" * 40_000])
def test_reading_takes_linear_time(broken):
    import time

    began = time.process_time()
    pages.extract(broken, pages.ALONE)
    pages.page_tokens(broken)
    assert time.process_time() - began < 1.0


@pytest.mark.parametrize("html, want", [
    ("<div class=hd><h1>Title</h1></div><div class=bd>" + "long text " * 50 + "</div>", "Title " + "long text " * 50),
    ("<div>A lead.</div><div><div>" + "long text " * 50 + "</div><div>To be continued.</div></div><div>End.</div>", "A lead. " + "long text " * 50 + "To be continued. End."),
    ("<div>Menu</div><h2>Menu</h2><div>Menu <b>of the day</b></div>", "Menu Menu of the day"),
])
def test_no_text_is_dropped_for_its_share(html, want):
    assert pages.extract(html, pages.ALONE) == want.strip()


def test_page_edges(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, "<p>a</p>", "t"), (None, "no url", "<p>a</p>", "t"), (2, "http://h/", "<p>a</p>" * 20000, "t")], "page_id long, url string, html string, text string")
    got = pages.main_text(df).collect()
    assert len(got) == 4 and max(r.n_chars for r in got) == 39999 and pages.main_text(df.limit(0)).count() == 0


# -- media -----------------------------------------------------------------
def _reference_png(pixels: np.ndarray, kinds) -> bytes:
    """Filters of all five kinds, by their definitions."""
    rows = []
    for y, line in enumerate(pixels):
        up = pixels[y - 1] if y else np.zeros_like(line)
        k, out = kinds[y % len(kinds)], []
        for x in range(len(line)):
            a, b, c = int(line[x - 1]) if x else 0, int(up[x]), int(up[x - 1]) if x else 0
            p = a + b - c
            near = min((a, b, c), key=lambda v: abs(p - v))
            out.append((int(line[x]) - (0, a, b, (a + b) // 2, near)[k]) & 255)
        rows.append(bytes([k, *out]))
    head = media.struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x") + media._chunk(b"IDAT", zlib.compress(b"".join(rows))) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_all_filters(kinds):
    pixels = np.random.default_rng(5).integers(0, 256, (7, 33), dtype=np.uint8)
    assert (media.read_png(_reference_png(pixels, kinds)) == pixels).all()


def test_png_round_trip_and_checksums():
    rng = np.random.default_rng(6)
    for n in (0, 1, 575, 576, 577, 5000, 300_000):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        png = media.write_png(media.pad(data), block=1000)
        assert media.read_png(png).tobytes() == media.pad(data)
    for at in (20, 40, len(png) // 2, len(png) - 6):
        with pytest.raises(ValueError):
            media.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.read_png(png[:-12])


def test_hash_is_stable_under_small_changes():
    rng = np.random.default_rng(7)
    x = np.kron(rng.integers(20, 230, (8, 8)), np.ones((12, 16))).astype(np.uint8)
    noisy = (x.astype(int) + rng.integers(-3, 4, x.shape)).astype(np.uint8)
    far = np.kron(rng.integers(20, 230, (8, 8)), np.ones((12, 16))).astype(np.uint8)
    d = lambda a, b: (int.from_bytes(media.cosine_hash(a)) ^ int.from_bytes(media.cosine_hash(b))).bit_count()
    assert d(x, x) == 0 and d(x, noisy) <= 6 < d(x, far)


def test_media_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = entries.op10_media(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        padded = media.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def _plain_hash(pixels: np.ndarray) -> str:
    """The cosine hash by its definition: area means, a transform by sums, signs against the median."""
    h, w = pixels.shape
    cut = lambda n: [(i * n // 32, max(i * n // 32 + 1, (i + 1) * n // 32)) for i in range(32)]
    starts = [a for a, _ in cut(w)]
    small = np.array([[pixels[a:b, c : (d if d > c else None)].mean() if (d := (starts + [w])[j + 1]) > c else pixels[a:b, c].mean() for j, c in enumerate(starts)] for a, b in cut(h)])
    low = [round(float(sum(small[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32))), 6) for u in range(8) for v in range(8)]
    return np.packbits(np.array(low) > np.median(low[1:])).tobytes().hex()


def test_media_query_against_brute_force(spark):
    """Stored form and feature of a sample of the query's rows: the image is read by its definition, pixel by pixel."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = entries.op10_media(spark, SMALL).orderBy("doc_id").collect()
    for r in rows[::20]:
        png = media.write_png(media.pad(texts[r.doc_id].encode()))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        at, idat, head = 8, b"", None
        while at < len(png):
            n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
            body = png[at + 8 : at + 8 + n]
            assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
            head, idat = (body if kind == b"IHDR" else head), idat + (body if kind == b"IDAT" else b"")
            at += 12 + n
        w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
        raw, lines = zlib.decompress(idat), []
        for y in range(h):
            kind, line, up = raw[y * (w + 1)], list(raw[y * (w + 1) + 1 : (y + 1) * (w + 1)]), lines[-1] if lines else [0] * w
            for x in range(w):
                a, b, c = line[x - 1] if x else 0, up[x], up[x - 1] if x else 0
                p = a + b - c
                line[x] = (line[x] + (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v)))[kind]) & 255
            lines.append(line)
        pixels = np.array(lines, np.uint8)
        assert pixels.tobytes() == media.pad(texts[r.doc_id].encode())
        if len(pixels) >= 32:
            assert r.feature == _plain_hash(pixels)
        assert r.feature == media.cosine_hash(pixels).hex()


def test_media_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "x" * 100_000, 3), (2, "x" * 100_000, 3)], "doc_id long, text string, media int")
    got = media.read_back(df).collect()
    assert len(got) == 4 and len({r.media_sha256 for r in got}) == 2
    made = media.store(df)
    assert made.columns == ["doc_id", "text", "media", "phash"] and media.read_png(bytes(made.first().media)).tobytes() == media.pad(b"")
    assert media.read_back(df.limit(0)).count() == 0
