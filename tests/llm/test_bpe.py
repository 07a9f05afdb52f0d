import hashlib
import random
from array import array

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from bucketlane.llm import bpe, entries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def pair():
    path, pattern = entries.vocabulary()
    t = bpe.Transducer(bpe.load_ranks(path), pattern)
    return t, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


def test_each_token_encodes_to_itself(pair):
    t, _ = pair
    for i in random.Random(1).sample(sorted(t.bytes_of), 3000):
        assert t.tokens_of([t.bytes_of[i]]) == [array("I", [i]).tobytes()] and list(t.stream(t.bytes_of[i])) == [i]


def test_equals_the_library(pair):
    t, ref = pair
    rng = random.Random(2)
    texts = ["", " ", "a", "<|endoftext|>", "\n\n  x \t y", "a" * 3000, "ing" * 2000, " " * 500 + "x", "é" * 700, "漢字🙂" * 200]
    texts += ["".join(rng.choice("aab  \n\té漢🙂'sTHEthe0189-_=/.<|  ") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    for x in texts:
        assert t.encode(x) == ref.encode_ordinary(x), x[:80]
        assert "".join(bpe.decode(t.encode(x), t.bytes_of)) == x


def test_all_ways_agree(pair, monkeypatch):
    t, ref = pair
    rng = random.Random(4)
    words = ["".join(rng.choice(["th", "ing", "qu", "é", "ß", "on", "re", "x"]) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    words += [" thereafter", " internationalization", "qzxqzx", " abcabcabc", "x" * 1500 + "ing" * 300]
    want = [ref.encode_ordinary(w) for w in words]
    for most in (bpe.MOST_STATES, 50):  # with 50, the machine starts anew all the time
        monkeypatch.setattr(bpe, "MOST_STATES", most)
        assert [array("I", x).tolist() for x in t.tokens_of([w.encode() for w in words])] == want == [list(t.stream(w.encode())) for w in words]


def test_every_piece_runs_on_the_machine(pair, monkeypatch):
    """Each byte of each new piece takes a transition of the machine, in step or alone, and nothing else gives tokens."""
    t = bpe.Transducer(pair[0].ranks, public_tokenizers.PATTERN)
    taken, real, alone = [], t._lasts, t.stream
    monkeypatch.setattr(t, "_lasts", lambda data, start, size: taken.append(int(size.sum())) or real(data, start, size))
    monkeypatch.setattr(t, "stream", lambda data: taken.append(len(data)) or alone(data))
    text = "some rare wordsofnovelkind are here, once; wordsofnovelkind\n\nagain 1234 " + "verylong" * 20
    assert t.encode(text) == pair[1].encode_ordinary(text)
    assert sum(taken) == sum(len(p.encode()) for p in set(t.find(text)))
    taken.clear()
    t.encode(text)
    assert sum(taken) == len(" " + "verylong" * 20)  # the rest is remembered


def test_memory_and_table():
    import numpy as np

    m = bpe.Memory(8)
    for i in range(100):
        m.update({i: str(i)})
        assert m.get_all([0, i, -1]) == ["0", str(i), None] and len(m.now) + len(m.before) <= 9
    rng = np.random.default_rng(0)
    table, keys = bpe.Table(2), rng.permutation(100_000)[:5000]
    for lo in range(0, 5000, 700):
        table.put(keys[lo : lo + 700], keys[lo : lo + 700] * 3, keys[lo : lo + 700] % 7)
    at = table.find(keys)
    assert (table.keys[at] == keys).all() and (table.to[at] == keys * 3).all() and (table.last[at] == keys % 7).all()
    assert (table.keys[table.find(np.arange(100_000, 101_000))] == -1).all()


def test_parts_of_long_texts(pair, monkeypatch):
    t, ref = pair
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "漢", " a", " b", "."]) for _ in range(3000))
    for most in (1, 50, 10**6):
        assert " ".join(bpe.parts(text, most)) == text
    whole = list(bpe._digests(t, pa.array([text, "", None, text])))
    monkeypatch.setattr(bpe, "CHUNK", 100)
    assert list(bpe._digests(t, pa.array([text, "", None, text]))) == whole
    ids = ref.encode_ordinary(text)
    assert whole[0] == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bounded_lookahead(pair):
    t, _ = pair
    seen, out = 0, 0

    def feed():
        nonlocal seen
        for b in ("the" * 400).encode():
            seen += 1
            yield b

    for token in t.stream(feed()):
        out += len(t.bytes_of[token])
        assert seen - out < 2 * t._longest


def test_utf8_machine():
    rng = random.Random(3)
    bytes_ = [65, 0xC3, 0xA9, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xED, 0xA0, 0xC0, 0xF4, 0x90]
    for _ in range(5000):
        raw, m, got = bytes(rng.choice(bytes_) for _ in range(rng.randint(0, 12))), bpe.Utf8(), ""
        at = 0
        while at < len(raw):
            n = rng.randint(1, 4)
            got, at = got + m.feed(raw[at : at + n]), at + n
        assert got + m.close() == raw.decode(errors="replace")


def test_query(spark, pair):
    t, ref = pair
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = entries.op2_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ref.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_edges(spark, pair):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "long word " * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, *entries.vocabulary()).collect()
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 0] and len(got) == 4
    made = bpe.encode(df, *entries.vocabulary(), ids="n_tokens")
    assert made.columns == df.columns and {len(r.n_tokens) for r in made.where(F.coalesce("text", F.lit("")) == "").collect()} == {0}
    assert bpe.round_trip(df.limit(0), *entries.vocabulary()).count() == 0
