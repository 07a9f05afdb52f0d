"""Quality classification by co-training two views.

The content view has shares and counts taken from the whole text (letters, marks, case, lines, repeated words) and its
words and letter trigrams, hashed; the metadata view has the page's source, language tag and length. Each is a logistic
model. In each round each view labels the unlabelled rows that it is surest of, as many good ones and bad ones as their
shares among the labels tell, for the other view to learn from. A quarter of the labelled rows is kept out of this to
calibrate each view (Platt scaling) and to weigh the calibrated views into one score.

Features of all rows are made once and written to the shared folder while the model is fitted. Labelled are about
LABELLED rows at most, a bounded sample by hash; rows of equal features and label count once. Unlabelled are all rows without a label: each round scores all of them and
takes the surest ones, up to GIVEN for each view in all rounds (rows of equal features count once). Scoring covers all rows
and whole texts.

Edge cases: null and empty texts score as empty content; null source and language are values of their own; labels of
null or for missing documents don't count; the labels of one document vote, a tie is good; rows that share an id share its
label; if all labels agree, or there are none, each score is their share (0.5 without labels); of equally sure rows those
of least hash are taken; rows that score the threshold exactly are accepted; repeated rows get equal scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.llm import bytewords
from bucketlane.llm.runtime import lean, remove, shared_dir, ship, spans, strings

LABELLED, GIVEN, ROUNDS, SLOTS, GRAMS, CHUNK = 8000, 1000, 4, 64, 64, 1 << 19
N_CONTENT, N_METADATA = 23 + 2 * GRAMS, SLOTS + 32 + 24


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, blank, line feed, dot and comma, other marks, beyond ASCII."""
    out = np.full(256, 6, np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 7
    out[[32, 9, 11, 12, 13]], out[10] = 3, 4
    out[[44, 46]] = 5
    return out


CLASSES = _classes()


def content(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text, with the precision of half floats."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    share = np.bincount(text * 8 + CLASSES[data], minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    w = bytewords.words(data, offsets, bytewords.NOT_SPACE)
    count = np.diff(w.first)
    some = np.maximum(count, 1)
    length = w.end - w.start
    mean = np.bincount(w.doc, length, n) / some
    last, first = data[w.end - 1], data[w.start]
    upper = CLASSES[first] == 1
    odd = CLASSES[last] == 6
    alone = (CLASSES[first] == 6) & (length == 1)
    loud = upper & (CLASSES[data[np.minimum(w.start + 1, len(data) - 1)]] == 1) if len(data) else upper
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n)
    top = np.zeros(n)
    if len(h):
        at = np.flatnonzero(new)
        np.maximum.at(top, d[at], np.diff(np.append(at, len(h))))
    per = lambda x: np.bincount(w.doc[x], minlength=n) / some
    # words and letter trigrams, hashed
    by_word = np.bincount(w.doc * GRAMS + (w.hash % np.uint64(GRAMS)).astype(np.int64), minlength=n * GRAMS).reshape(n, GRAMS) / some[:, None]
    at = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, np.int64)
    code = (w.data[at].astype(np.uint64) << np.uint64(16)) | (w.data[at + 1].astype(np.uint64) << np.uint64(8)) | w.data[at + 2 if len(at) else at]
    by_gram = np.bincount(text[at] * GRAMS + (bytewords.mix(code) % np.uint64(GRAMS)).astype(np.int64), minlength=n * GRAMS).reshape(n, GRAMS) / np.maximum(size - 2, 1)[:, None]
    return np.column_stack([
        share, mean / 10, per(upper), per(odd), per(alone), per(loud), per(again), distinct / np.sqrt(some) / 10, distinct / some,
        top / some, np.log1p(count) / 5, np.sqrt(per(odd)), np.sqrt(per(alone)), np.sqrt(per(loud)), np.sqrt(per(again)), (count == 0),
        np.sqrt(by_word), np.sqrt(by_gram),
    ]).astype(np.float16).astype(np.float64)


def metadata(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Three columns that are 1 in each row: hashed source and language, and length band."""
    out = np.zeros((len(source), 3), np.int16)
    for i, (s, l, c) in enumerate(zip(source, lang, n_chars)):
        out[i, 0] = xxhash.xxh64_intdigest(f"s{s}") % SLOTS
        out[i, 1] = SLOTS + xxhash.xxh64_intdigest(f"l{l}") % 32
        out[i, 2] = SLOTS + 32 + min(23, int(np.log2(max(0, c or 0) + 1)))
    return out


def widened(columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(columns), N_METADATA))
    out[np.arange(len(columns))[:, None], columns] = 1
    return out


@dataclass
class Logistic:
    """Standardised logistic regression, fitted by Newton steps with a ridge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


@dataclass
class Model:
    """Two views, each with its calibration (slope, shift), and the weights of the calibrated views. Or just a share."""

    share: float
    views: tuple[Logistic, Logistic] | None = None
    calibrated: tuple[Logistic, Logistic] | None = None
    mixed: Logistic | None = None

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(combined, content, metadata) probabilities of good quality."""
        if self.views is None:
            return np.full((len(a), 3), self.share)
        x = [c.logit(v.logit(f)[:, None]) for v, c, f in zip(self.views, self.calibrated, (a, b))]
        return 1 / (1 + np.exp(-np.column_stack([self.mixed.logit(np.column_stack(x)), *x])))


#: Features of rows: content, metadata.
Rows = tuple[np.ndarray, np.ndarray]
#: Given the views' models, and how many bad and good ones are wanted: by view, the surest bad and good ones of the
#: unlabelled rows that weren't given before.
Pick = Callable[[list[Logistic], int, int], list[tuple[Rows, Rows]]]


def cotrain(labelled: Rows, y: np.ndarray, pick: Pick, given: int = GIVEN, rounds: int = ROUNDS, seed: int = 3) -> Model:
    """given: rows that each view labels for the other one in all rounds."""
    good = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or not 0 < good < 1:
        return Model(good)
    order = np.random.default_rng(seed).permutation(len(y))
    held, train = order[: len(y) // 4], order[len(y) // 4 :]
    if not 0 < y[held].mean() < 1 or not 0 < y[train].mean() < 1:
        held = train = order
    own = [(f[train], y[train]) for f in labelled]
    k = max(1, given // rounds)
    for _ in range(rounds):
        for v, (bad, fine) in enumerate(pick([logistic(*o) for o in own], max(1, round(k * (1 - good))), max(1, round(k * good)))):
            other = 1 - v
            own[other] = (np.concatenate([own[other][0], bad[other], fine[other]]), np.concatenate([own[other][1], np.zeros(len(bad[other])), np.ones(len(fine[other]))]))
    views = tuple(logistic(*o) for o in own)
    logits = [v.logit(f[held])[:, None] for v, f in zip(views, labelled)]
    calibrated = tuple(logistic(x, y[held]) for x in logits)
    mixed = logistic(np.column_stack([c.logit(x) for c, x in zip(calibrated, logits)]), y[held])
    return Model(good, views, calibrated, mixed)


def _surest(models: list[Logistic], rows: Rows, prints: np.ndarray, want: tuple[int, int]) -> list[tuple[int, int, float, int]]:
    """(view, side, doubt, row number) of the surest rows; only rows on the right side of a view's own threshold are sure.
    Rows of equal print count once."""
    once, out = np.unique(prints, return_index=True)[1], []
    for v, m in enumerate(models):
        p = m.logit(rows[v][once])
        for side, doubt in enumerate((p, -p)):
            sure = np.flatnonzero(doubt < -1)
            best = sure[np.lexsort((prints[once[sure]], doubt[sure]))[: want[side]]]
            out += [(v, side, float(doubt[i]), int(once[i])) for i in best]
    return out


def prints_of(content_: np.ndarray, metadata_: np.ndarray) -> np.ndarray:
    """A hash of each row's features."""
    return np.array([xxhash.xxh64_intdigest(a.tobytes() + m.tobytes()) - (1 << 63) for a, m in zip(content_.astype(np.float16), metadata_)], np.int64)


def from_arrays(content_: np.ndarray, metadata_: np.ndarray, wide: np.ndarray | None = None) -> Pick:
    """Picks from rows in memory. wide: the metadata as the models see it."""
    free = {"rows": (content_, widened(metadata_) if wide is None else wide), "prints": prints_of(content_, metadata_)}

    def pick(models, bad, fine):
        rows, prints = free["rows"], free["prints"]
        got = _surest(models, rows, prints, (bad, fine))
        taken = np.isin(prints, [prints[i] for *_, i in got])
        out = []
        for v in (0, 1):
            sides = [[i for view, s, _, i in got if (view, s) == (v, side)] for side in (0, 1)]
            out.append(tuple((rows[0][i], rows[1][i]) for i in sides))
        free["rows"], free["prints"] = (rows[0][~taken], rows[1][~taken]), prints[~taken]
        return out

    return pick


def from_table(pool: DataFrame) -> Pick:
    """Picks from all rows (a, m, print) of a table; only the picked rows come to the driver."""
    taken: set[int] = set()

    def pick(models, bad, fine):
        shared = pool.sparkSession.sparkContext.broadcast((models, np.array(sorted(taken), np.int64)))  # at most 2 * GIVEN prints

        def run(batches):
            models, given = shared.value
            best: dict[tuple[int, int], dict[int, tuple]] = {(v, side): {} for v in (0, 1) for side in (0, 1)}
            for b in batches:
                prints = b.column(2).to_numpy()
                at = np.flatnonzero(~np.isin(prints, given))
                if not len(at):
                    continue
                some = b.take(pa.array(at))
                for v, side, doubt, i in _surest(models, _wide(some.column(0), some.column(1)), prints[at], (bad, fine)):
                    best[v, side][int(prints[at[i]])] = (doubt, some.column(0)[i].as_py(), some.column(1)[i].as_py())
                for (v, side), rows in best.items():
                    n = (bad, fine)[side]
                    if len(rows) > 4 * n:
                        best[v, side] = dict(sorted(rows.items(), key=lambda x: (x[1][0], x[0]))[:n])
            rows = [(v, side, doubt, p, a, m) for (v, side), found in best.items() for p, (doubt, a, m) in sorted(found.items(), key=lambda x: (x[1][0], x[0]))[: (bad, fine)[side]]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["view", "side", "doubt", "print", "a", "m"])

        found = pool.select("a", "m", "print").mapInArrow(lean(run), "view int, side int, doubt double, print long, a binary, m binary")
        found = found.groupBy("view", "side", "print").agg(F.min(F.struct("doubt", "a", "m")).alias("x")).select("view", "side", "print", "x.*").persist()
        out, new = [], set()
        for v in (0, 1):
            sides = []
            for side, n in enumerate((bad, fine)):
                got = found.where((F.col("view") == v) & (F.col("side") == side)).orderBy("doubt", "print").limit(n).collect()  # a top-k
                new.update(r["print"] for r in got)
                sides.append(_wide(pa.array([bytes(r.a) for r in got], pa.binary()), pa.array([bytes(r.m) for r in got], pa.binary())))
            out.append(tuple(sides))
        taken.update(new)
        found.unpersist()
        shared.destroy()
        return out

    return pick


def _packed(content_: np.ndarray, metadata_: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array([x.tobytes() for x in content_.astype(np.float16)], pa.binary()), pa.array([x.tobytes() for x in metadata_], pa.binary())


def _wide(a: pa.Array, m: pa.Array) -> Rows:
    content_ = np.frombuffer(b"".join(a.to_pylist()), np.float16).reshape(-1, N_CONTENT).astype(np.float64)
    return content_, widened(np.frombuffer(b"".join(m.to_pylist()), np.int16).reshape(-1, 3))


def _features(b: pa.RecordBatch, text: str, source: str, lang: str, n_chars: str) -> Rows:
    """Content, and columns of the metadata."""
    data, offsets = strings(b.column(text))
    parts = [content(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in spans(offsets, CHUNK)]
    a = np.concatenate(parts) if parts else np.zeros((0, N_CONTENT))
    return a, metadata(*(b.column(c).to_pylist() for c in (source, lang, n_chars)))


def features(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(a, m, print, y) of each row of docs: packed features, their hash, and the label or null."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((F.avg((F.col(label) > 0).cast("int")) >= 0.5).cast("double").alias("y"))
    rows = docs.select(F.col(key).alias("id"), *(F.col(c).alias(k) for k, c in (("text", text), ("source", source), ("lang", lang), ("n_chars", n_chars))))

    def run(batches):
        for b in batches:
            a, m = _features(b, "text", "source", "lang", "n_chars")
            yield pa.RecordBatch.from_arrays([b.column("id"), *_packed(a, m), pa.array(prints_of(a, m))], ["id", "a", "m", "print"])

    made = rows.mapInArrow(lean(run), f"id {docs.schema[key].dataType.simpleString()}, a binary, m binary, print long")
    return made.join(told, "id", "left").select("a", "m", "print", "y")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", key: str = "doc_id", label: str = "quality") -> Model:
    """The model of the labels of `docs`: co-trained over all its rows."""
    spark = docs.sparkSession
    ship(spark)
    folder = f"{shared_dir(spark)}/quality-{uuid.uuid4().hex}"
    try:
        features(docs, labels, text, source, lang, n_chars, key, label).write.parquet(folder)
        made = spark.read.parquet(folder)
        pool = made.where("y is null")
        told = made.where("y is not null").dropDuplicates(["print", "y"])
        share = min(1.0, LABELLED / max(1, told.count()))
        # a bounded sample: about LABELLED rows, in an order of their own
        known = sorted(told.where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < share * (1 << 30)).collect(), key=lambda r: (r["print"], r.y))
        y = np.array([r.y for r in known])
        rows = _wide(pa.array([bytes(r.a) for r in known], pa.binary()), pa.array([bytes(r.m) for r in known], pa.binary()))
        return cotrain(rows, y, from_table(pool), min(GIVEN, pool.count() // 10))
    finally:
        remove(spark, folder)


def _scores(b: pa.RecordBatch, model: Model, names: tuple[str, str, str, str]) -> np.ndarray:
    a, m = _features(b, *names)
    return model.scores(a, widened(m))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """doc_id, quality_score, content_score, metadata_score, accepted of each row. One pass, no shuffle."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            p = _scores(b, shared.value, (text, source, lang, n_chars))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(3)), pa.array(p[:, 0] >= 0.5)], ["doc_id", "quality_score", "content_score", "metadata_score", "accepted"])

    return df.select(key, text, source, lang, n_chars).mapInArrow(lean(run), f"doc_id {df.schema[key].dataType.simpleString()}, quality_score double, content_score double, metadata_score double, accepted boolean")


def keep_good(df: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", least: float = 0.5) -> DataFrame:
    """The rows that score at least `least`, all columns as they are."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(b, shared.value, (text, source, lang, n_chars))[:, 0] >= least))

    return df.mapInArrow(lean(run), df.schema)
