"""Language identification with a linear-chain conditional random field over words.

Each word gets a label (a language) from its features: affixes of one to three letters, letter bigrams and trigrams, and
itself where it is in the lexicon of frequent training words. Learned transitions tie neighbours, so words of
code-switched text get their own labels. Posteriors come from forward-backward: texts are cut into blocks of BLOCK
words, each block's transfer matrix is made in lockstep with all others, and block borders are then passed on, which
gives the same as one long pass. Long texts go through in parts: forward, keeping what passes each border, then backward.

Training takes a bounded sample of the labelled rows: at most PER_LANG texts of each language (fewer where MOST_TEXTS would
be exceeded), by text hash, and of each text that has more than EXCERPT characters as many from PLACES places all over it.
They are cut into spans that are chained across languages, so transitions see switches. Prediction reads whole texts.
There may be any number of languages; one number of each comes to the driver.

Edge cases: a null text, or one without letters, is `und` with score 0; without labelled texts all is `und`; ties go to
the language that sorts first; repeated rows get equal results. Letters are what Unicode calls so.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.llm import bytewords
from bucketlane.llm.runtime import lean, ship

PER_LANG, EXCERPT, PLACES, MOST_TEXTS = 300, 1500, 12, 10_000
#: Weights are 2^BITS for each label, fewer where there would be more than MOST_WEIGHTS in all.
BITS, MOST_WEIGHTS, BLOCK, CHUNK = 16, 1 << 24, 64, 1 << 17
_U = np.uint64
_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For all code points: whether it's a letter, and its lower case."""
    if not _TABLES:
        letter = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                letter[c] = unicodedata.category(ch)[0] == "L"
                if (low := ch.lower()) != ch and len(low) == 1:
                    lower[c] = ord(low)
        _TABLES.extend((letter, lower))
    return _TABLES[0], _TABLES[1]


@dataclass
class Tokens:
    """Words of several texts: text ranges first[i]:first[i + 1], and for each word the number of its distinct form."""

    first: np.ndarray
    form: np.ndarray
    #: features of form i: index[start[i]:start[i + 1]], with weights
    start: np.ndarray
    index: np.ndarray
    weight: np.ndarray
    hash: np.ndarray


def tokenize(texts: list[str | None], lexicon: np.ndarray, bits: int = BITS) -> Tokens:
    letter, lower = tables()
    codes = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.concatenate([letter[codes], [False]])
    codes = lower[codes].astype(np.uint64)
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(begin, offsets[:-1])
    first = np.append(first, len(begin))
    size = end - begin
    if not len(begin):
        z = np.zeros(0, np.int64)
        return Tokens(first, z, np.zeros(1, np.int64), z, np.zeros(0), np.zeros(0, np.uint64))
    base = np.cumsum(size) - size
    at = np.repeat(begin - base, size) + np.arange(int(size.sum()))
    flat = codes[at]
    with np.errstate(over="ignore"):
        value = (flat + _U(1)) * bytewords.powers(int(size.max()))[np.arange(len(flat)) - np.repeat(base, size)]
        word = bytewords.mix(np.add.reduceat(value, base) + bytewords.mix(size.astype(np.uint64)))
    known, where, form = np.unique(word, return_index=True, return_inverse=True)
    size, begin = size[where], begin[where]
    # features of the distinct words
    n = len(known)
    ids, owner, weight = [], [], []

    def put(h: np.ndarray, of: np.ndarray, w: np.ndarray, kind: int) -> None:
        ids.append((bytewords.mix(h + _U(kind * 0x1F123BB5)) >> _U(64 - bits)).astype(np.int64))
        owner.append(of)
        weight.append(w)

    every = np.arange(n)
    with np.errstate(over="ignore"):
        for k in (1, 2, 3):
            of = every[size >= k]
            front, back = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
            for i in range(k):
                front = front * _U(0x100000001B3) + codes[begin[of] + i] + _U(1)
                back = back * _U(0x100000001B3) + codes[begin[of] + size[of] - k + i] + _U(1)
            put(front, of, np.ones(len(of)), k)
            put(back, of, np.ones(len(of)), 3 + k)
        for k in (2, 3):
            many = np.maximum(size - k + 1, 0)
            of = np.repeat(every, many)
            pos = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            gram = np.zeros(len(pos), np.uint64)
            for i in range(k):
                gram = gram * _U(0x100000001B3) + codes[pos + i] + _U(1)
            put(gram, of, 2.0 / np.maximum(many[of], 2), 6 + k)
        if len(lexicon):
            i = np.minimum(np.searchsorted(lexicon, known), len(lexicon) - 1)
            of = every[lexicon[i] == known]
            put(known[of], of, np.full(len(of), 2.0), 10)
    owner_ = np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    start = np.searchsorted(owner_[order], np.arange(n + 1))
    return Tokens(first, form, start, np.concatenate(ids)[order], np.concatenate(weight)[order], known)


def emissions(t: Tokens, weights: np.ndarray) -> np.ndarray:
    """Score of each distinct word and label; each word has features, if only its first letter."""
    if not len(t.start) - 1:
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[t.index] * t.weight[:, None], t.start[:-1], axis=0)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray  # log scores
    lexicon: np.ndarray


@dataclass
class Lattice:
    """Words of several texts in blocks: text i has the blocks base[i]:base[i] + blocks[i]."""

    base: np.ndarray
    blocks: np.ndarray
    place: tuple[np.ndarray, np.ndarray]  # of each word: column in its block, block
    e: np.ndarray  # by column, block and label
    real: np.ndarray
    a: np.ndarray
    m: np.ndarray  # transfer matrix of each block

    @classmethod
    def of(cls, first: np.ndarray, scores: np.ndarray, transitions: np.ndarray) -> Lattice:
        n, labels = scores.shape
        length = np.diff(first)
        blocks = -(-length // BLOCK)
        n_blocks = int(blocks.sum())
        base = np.cumsum(blocks) - blocks
        text = np.repeat(np.arange(len(length)), length)
        local = np.arange(n) - first[:-1][text]
        place = local % BLOCK, base[text] + local // BLOCK
        e = np.ones((BLOCK, n_blocks, labels))
        e[place] = np.exp(scores - scores.max(1, keepdims=True))
        real = np.zeros((BLOCK, n_blocks, 1), bool)
        real[place] = True
        a = np.exp(transitions - transitions.max())
        m = np.broadcast_to(np.eye(labels), (n_blocks, labels, labels)).copy()
        for t in range(BLOCK):
            new = (m @ a) * e[t][:, None, :]
            new /= new.sum((1, 2), keepdims=True)
            m = np.where(real[t][:, :, None], new, m)
        return cls(base, blocks, place, e, real, a, m)

    def through(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """What comes out of the blocks, one after the other, if x goes in at the first one (back: at the last one)."""
        for m in self.m[::-1] if back else self.m:
            x = m @ x if back else x @ m
            x = x / x.sum()
        return x

    def posteriors(self, x: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
        """Label posteriors of each word; x and y: what goes into the texts' first and last blocks, else all labels alike."""
        n_blocks, labels = self.m.shape[:2]
        into, out = np.full((n_blocks, labels), 1 / labels), np.full((n_blocks, labels), 1 / labels)
        some = self.blocks > 0
        if x is not None:
            into[self.base[some]] = x
        if y is not None:
            out[(self.base + self.blocks - 1)[some]] = y
        # pass borders on: block number k of all texts at once
        for k in range(1, int(self.blocks.max())):
            b = self.base[self.blocks > k] + k
            z = np.einsum("bi,bij->bj", into[b - 1], self.m[b - 1])
            into[b] = z / z.sum(1, keepdims=True)
        for k in range(int(self.blocks.max()) - 2, -1, -1):
            b = self.base[self.blocks > k + 1] + k
            z = np.einsum("bij,bj->bi", self.m[b + 1], out[b + 1])
            out[b] = z / z.sum(1, keepdims=True)
        alpha = np.empty_like(self.e)
        now = into
        for t in range(BLOCK):
            new = (now @ self.a) * self.e[t]
            now = np.where(self.real[t], new / new.sum(1, keepdims=True), now)
            alpha[t] = now
        now = out
        for t in range(BLOCK - 1, -1, -1):
            alpha[t] *= now
            new = (now * self.e[t]) @ self.a.T
            now = np.where(self.real[t], new / new.sum(1, keepdims=True), now)
        got = alpha[self.place]
        return got / got.sum(1, keepdims=True)


def posteriors(first: np.ndarray, scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward: label posteriors of each word; texts are first[i]:first[i + 1]."""
    return Lattice.of(first, scores, transitions).posteriors() if len(scores) else scores


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model:
    """Trains by gradient ascent on the conditional likelihood of chained spans (AdaGrad)."""
    names = sorted(set(langs))
    label = {x: i for i, x in enumerate(names)}
    bits = min(BITS, (MOST_WEIGHTS // max(1, len(names))).bit_length() - 1)
    size, n_labels, rng = 1 << bits, len(names), np.random.default_rng(seed)
    plain = tokenize(texts, np.zeros(0, np.uint64), bits)
    count = np.bincount(plain.form, minlength=len(plain.hash)) if len(plain.form) else np.zeros(0, int)
    lexicon = np.sort(plain.hash[count >= 3])
    t = tokenize(texts, lexicon, bits)
    # spans of up to 12 words, then sequences of 4 spans
    spans = [(f, min(f + 12, int(t.first[i + 1])), label[langs[i]]) for i in range(len(texts)) for f in range(int(t.first[i]), int(t.first[i + 1]), 12)]
    w, trans = np.zeros((size, n_labels)), np.zeros((n_labels, n_labels))
    gw, gt = np.full((size, n_labels), 1e-3), np.full((n_labels, n_labels), 1e-3)
    for _ in range(epochs if spans else 0):
        # half of the sequences keep one language, the others switch
        order = rng.permutation(len(spans))
        order = order[np.argsort(np.array([spans[i][2] for i in order]) if rng.random() < 0.5 else rng.random(len(order)), kind="stable")]
        groups = [order[i : i + 4] for i in range(0, len(order), 4)]
        rng.shuffle(groups)
        many_ = max(4, min(256, (1 << 18) // n_labels**2))
        for lo in range(0, len(groups), many_):
            batch = groups[lo : lo + many_]
            word = np.full((len(batch), 48), -1, np.int64)
            gold = np.zeros((len(batch), 48), np.int64)
            for r, g in enumerate(batch):
                c = 0
                for s in g:
                    a, b, l = spans[s]
                    word[r, c : c + b - a], gold[r, c : c + b - a] = t.form[a:b], l
                    c += b - a
            forms, back = np.unique(word, return_inverse=True)
            back, real = back.reshape(word.shape), word >= 0
            forms = np.where(forms < 0, 0, forms)
            many = t.start[forms + 1] - t.start[forms]
            flat = np.repeat(t.start[forms] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            idx, val, own = t.index[flat], t.weight[flat], np.repeat(np.arange(len(forms)), many)
            score = np.add.reduceat(w[idx] * val[:, None], np.cumsum(many) - many, axis=0)[back]
            e, a = np.exp(score - score.max(2, keepdims=True)), np.exp(trans - trans.max())
            alpha, beta = np.empty_like(e), np.empty_like(e)
            now = np.full((len(batch), n_labels), 1 / n_labels)
            for k in range(48):
                new = (now @ a) * e[:, k]
                now = np.where(real[:, k, None], new / new.sum(1, keepdims=True), now)
                alpha[:, k] = now
            now = np.full((len(batch), n_labels), 1 / n_labels)
            for k in range(47, -1, -1):
                beta[:, k] = now
                new = (now * e[:, k]) @ a.T
                now = np.where(real[:, k, None], new / new.sum(1, keepdims=True), now)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            both = real[:, 1:] & real[:, :-1]
            pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            seen = np.zeros_like(trans)
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            dt = (seen - pair[both].sum(0)) / len(batch)
            diff = (np.eye(n_labels)[gold] - post) * real[:, :, None]
            per_form = np.zeros((len(forms), n_labels))
            np.add.at(per_form, back.ravel(), diff.reshape(-1, n_labels))
            dw = np.stack([np.bincount(idx, val * per_form[own, l], size) for l in range(n_labels)], 1) / len(batch) - 1e-5 * w
            gw += dw * dw
            gt += dt * dt
            w += rate * dw / np.sqrt(gw)
            trans += 0.2 * dt / np.sqrt(gt)
    return Model(names, w.astype(np.float32), trans, lexicon)


def _chunk(model: Model) -> int:
    """Characters that are worked on at once; fewer with many labels, as transfer matrices have their square."""
    return max(1 << 12, CHUNK * 16 // max(16, len(model.langs) ** 2))


def _scores(model: Model, texts: list[str | None]) -> tuple[Tokens, np.ndarray]:
    t = tokenize(texts, model.lexicon, (len(model.weights) - 1).bit_length())
    return t, emissions(t, model.weights)[t.form]


def _by_part(model: Model, text: str):
    """Posteriors of a long text's words, part by part, from the last one to the first one."""
    letter, cuts = tables()[0], [0]
    while cuts[-1] < len(text):
        at = min(cuts[-1] + _chunk(model), len(text))
        while at < len(text) and letter[ord(text[at])]:
            at += 1
        cuts.append(at)
    lattices = lambda a, b: Lattice.of(*(lambda t, x: (t.first, x))(*_scores(model, [text[a:b]])), model.transitions)
    x, into = np.full(len(model.langs), 1 / len(model.langs)), []
    y = x
    for a, b in zip(cuts, cuts[1:]):
        into.append(x)
        x = lattices(a, b).through(x)
    for i in range(len(into) - 1, -1, -1):
        now = lattices(cuts[i], cuts[i + 1])
        if len(now.m):
            yield now.posteriors(into[i], y)
            y = now.through(y, back=True)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, mean posterior) of each text."""
    if not model.langs:
        return [("und", 0.0)] * len(texts)
    if len(texts) == 1 and len(texts[0] or "") > 2 * _chunk(model):
        total, count = np.zeros((1, len(model.langs))), np.zeros(1, np.int64)
        for p in _by_part(model, texts[0]):
            total, count = total + p.sum(0), count + len(p)
    else:
        t, scores = _scores(model, texts)
        if not len(t.form):
            return [("und", 0.0)] * len(texts)
        sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(posteriors(t.first, scores, model.transitions), axis=0)])
        total, count = sums[t.first[1:]] - sums[t.first[:-1]], np.diff(t.first)
    mean = total / np.maximum(count, 1)[:, None]
    best = mean.argmax(1)
    return [(model.langs[b], min(1.0, max(0.0, float(m[b])))) if c else ("und", 0.0) for b, m, c in zip(best, mean, count)]


def label_words(model: Model, text: str) -> list[tuple[str, str]]:
    """(word, language) of a code-switched text, in order; words in lower case are told apart by their letters alone."""
    if not model.langs:
        return []
    labels = [i for p in reversed([p.argmax(1) for p in _by_part(model, text)]) for i in p.tolist()]
    letter, _ = tables()
    words, now = [], ""
    for ch in text + " ":
        if letter[ord(ch)]:
            now += ch
        elif now:
            words.append(now)
            now = ""
    return [(w, model.langs[i]) for w, i in zip(words, labels)]


def excerpts(text: str, seed: int = 0, most: int = EXCERPT, places: int = PLACES) -> str:
    """The text, or if it's longer than `most` characters about as many from `places` places at equal distances, the first of
    which the seed tells. Each has whole words, unless there are hardly any blanks, and a line of its own."""
    if len(text) <= most:
        return text
    step, size = len(text) // places, most // places
    at = seed % step
    out = []
    for a in range(at, at + step * places, step):
        words = text[max(0, a - 1) : a + size + 1].split()
        out.append(" ".join(words[1:-1] if len(words) > 2 else words))
    return "\n".join(out)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """The model of a bounded sample of the rows: for each language, up to `per_lang` distinct texts of least hash."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    per_lang = max(1, min(per_lang, MOST_TEXTS // len(sizes)))
    share = labelled.sparkSession.createDataFrame([(k, min(1.0, 2 * per_lang / max(n, 1))) for k, n in sizes.items()], "lang string, share double")
    some = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "h", "text")  # a row a language

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([excerpts(x, h) for h, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.string())], ["lang", "h", "text"])

    # at most about 2 * per_lang distinct texts of each language, of bounded size
    got = some.mapInArrow(lean(run), "lang string, h long, text string").groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.h & (2**64 - 1))):
        by.setdefault(r.lang, []).append(r.text)
    picked = [(t, k) for k, ts in by.items() for t in ts[:per_lang]]
    return fit([t for t, _ in picked], [k for _, k in picked])


def _batches(column: pa.Array, chunk: int):
    """Lists of texts of about `chunk` characters; a longer one stands alone."""
    some, size = [], 0
    for x in column:
        text = x.as_py()
        if some and size + len(text or "") > chunk:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text or "") + BLOCK  # no text has less than a block
    if some:
        yield some


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row. One pass, no shuffle; the model has 2^16 weights for each language."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [p for some in _batches(b.column(1), _chunk(shared.value)) for p in predict(shared.value, some)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.select(key, text).mapInArrow(lean(run), f"doc_id {df.schema[key].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, text: str = "text", least: float = 0.35) -> DataFrame:
    """The rows whose text has a language of at least this score, all columns as they are. A model without languages rejects
    only texts that have no letter."""
    ship(df.sparkSession)
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        for b in batches:
            if not shared.value.langs:
                yield b.filter(pa.array([any(map(str.isalpha, x.as_py() or "")) for x in b.column(at)], pa.bool_()))
                continue
            got = [p for some in _batches(b.column(at), _chunk(shared.value)) for p in predict(shared.value, some)]
            yield b.filter(pa.array([g[0] != "und" and g[1] >= least for g in got], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
