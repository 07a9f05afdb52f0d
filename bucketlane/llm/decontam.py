"""Benchmark decontamination by winnowing.

Words are lower-cased runs of digits, ASCII letters and bytes beyond ASCII. A window is `span` consecutive words of an
item, or all words of a shorter item. Winnowing keeps, of each `span - k + 1` consecutive k-gram hashes, the least (all
equal ones), so any shared run of `span` words leaves a common fingerprint in both texts. Fingerprints of documents that
the benchmark has too are hits; each hit is extended to all windows around it, and those are compared word by word.
Items of fewer words than `span` are found by the same code with k = their length and every gram kept.

Benchmarks of up to `most` windows (counted first) go to all workers and documents take one pass without a shuffle.
Larger ones are joined: distinct fingerprints, then the windows around hits, both dealt by their hash.

Edge cases: null and empty texts have no words and no hits; items without words never match; items that repeat count
once by their id; an item whose id is null makes hits but isn't listed; repeated documents stay.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.llm import bytewords
from bucketlane.llm.runtime import checkpoint, free, lean, ship, spans, strings

SPAN, K, MOST = 10, 5, 200_000


def winnow(h: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of the grams that are least in some window of `width` consecutive valid grams."""
    n = len(h)
    if width == 1 or not n:
        return np.flatnonzero(valid)
    h = np.where(valid, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    m = n - width + 1
    if m <= 0:
        return np.flatnonzero(valid)
    low, whole = h[:m].copy(), valid[:m].copy()
    for i in range(1, width):
        np.minimum(low, h[i : i + m], out=low)
        whole &= valid[i : i + m]
    # a gram is kept if a whole window around it has no lesser one
    top = np.where(whole, low, np.uint64(0))
    keep = np.zeros(n, bool)
    for i in range(width):
        keep[i : i + m] |= (h[i : i + m] == top) & whole
    return np.flatnonzero(keep & valid)


def scan(data: np.ndarray, offsets: np.ndarray) -> bytewords.Words:
    return bytewords.words(data, offsets, bytewords.ALNUM)


def phrase(w: bytewords.Words, at: int, n: int) -> bytes:
    """n words from word `at`, joined by blanks."""
    return b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(at, at + n))


@dataclass
class Benchmark:
    """Windows of one length: fingerprints, window hashes (sorted) and, by hash, the windows' words and items."""

    n: int
    k: int
    prints: np.ndarray
    hashes: np.ndarray
    windows: dict[int, dict[bytes, frozenset]]


def _near(w: bytewords.Words, n: int, k: int, prints) -> np.ndarray:
    """Starts of windows of n words, inside one text, that hold a kept k-gram for which `prints` says yes."""
    h, valid = bytewords.grams(w.hash, w.doc, k)
    at = winnow(h, valid, n - k + 1)
    at = at[prints(h[at])]
    if not len(at):
        return at
    starts = np.unique((at[:, None] - np.arange(n - k + 1)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts + n <= len(w.doc))]
    return starts[w.doc[starts] == w.doc[starts + n - 1]]


def _member(sorted_: np.ndarray):
    def test(x: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.zeros(len(x), bool)
        i = np.searchsorted(sorted_, x)
        i[i == len(sorted_)] = 0
        return sorted_[i] == x

    return test


def index(items: list[tuple[object, str | None]], span: int = SPAN, k: int = K) -> list[Benchmark]:
    """Of (item_id, text) rows, one Benchmark for each window length."""
    texts = pa.array([t for _, t in items], pa.string())
    data, offsets = strings(texts)
    w = scan(data, offsets)
    count = np.diff(w.first)
    out = []
    for n in sorted({min(span, int(c)) for c in count if c}):
        gram = k if n == span else n
        chosen = count >= span if n == span else count == n
        found: dict[int, dict[bytes, set]] = {}
        prints = []
        h, valid = bytewords.grams(w.hash, w.doc, gram)
        kept = winnow(h, valid, n - gram + 1)
        prints.append(h[kept[chosen[w.doc[kept]]]])
        g, _ = bytewords.grams(w.hash, w.doc, n, 1)
        for i in np.flatnonzero(chosen).tolist():
            for s in range(int(w.first[i]), int(w.first[i + 1]) - n + 1):
                found.setdefault(int(g[s]), {}).setdefault(phrase(w, s, n), set()).add(items[i][0])
        windows = {a: {b: frozenset(x) for b, x in c.items()} for a, c in found.items()}
        out.append(Benchmark(n, gram, np.unique(np.concatenate(prints)), np.array(sorted(windows), np.uint64), windows))
    return out


def _mark(n_words: int, starts: list[tuple[int, int]]) -> int:
    """How many of n_words words lie in the windows (start, length)."""
    change = np.zeros(n_words + 1, np.int64)
    for s, n in starts:
        change[s] += 1
        change[s + n] -= 1
    return int((np.cumsum(change)[:n_words] > 0).sum())


def hits(data: np.ndarray, offsets: np.ndarray, bench: list[Benchmark]) -> list[tuple[int, int, set]]:
    """For each text (number of words, words hit, items with occurring windows)."""
    w = scan(data, offsets)
    out = [(int(n), 0, set()) for n in np.diff(w.first)]
    found: dict[int, list[tuple[int, int]]] = {}
    for b in bench:
        starts = _near(w, b.n, b.k, _member(b.prints))
        if not len(starts):
            continue
        h = _grams_at(w.hash, starts, b.n)
        for s, x in zip(starts[ok := _member(b.hashes)(h)].tolist(), h[ok].tolist()):
            if (items := b.windows[x].get(phrase(w, s, b.n))) is not None:
                d = int(w.doc[s])
                found.setdefault(d, []).append((s - int(w.first[d]), b.n))
                out[d][2].update(items)
    for d, starts in found.items():
        out[d] = (out[d][0], _mark(out[d][0], starts), out[d][2])
    return out


def _grams_at(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """What bytewords.grams(…, n, 1) gives at these starts."""
    with np.errstate(over="ignore"):
        out = np.full(len(starts), np.uint64(3))
        for i in range(n):
            out = bytewords.mix(out * np.uint64(bytewords._P) + hashes[starts + i])
    return out


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in ids if x is not None)).encode()).hexdigest()


_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
_COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _rows(texts: pa.Array, bench: list[Benchmark]) -> list[tuple]:
    data, offsets = strings(texts)
    rows = []
    for lo, hi in spans(offsets, 1 << 19):
        part = offsets[lo : hi + 1]
        for n, hit, ids in hits(data[part[0] : part[-1]], part - part[0], bench):
            named = ids - {None}
            rows.append((n, hit, len(named), items_digest(named), hit > 0))
    return rows


def small(benchmark: DataFrame, item: str, text: str, span: int, k: int, most: int) -> list[Benchmark] | None:
    """The index of a benchmark of at most `most` windows, else None. A window never costs more than 16 bytes a word plus
    its words, whose total length is tested as well."""
    bytes_, n = benchmark.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count(F.lit(1))).first()
    # a word takes a byte and a blank, so bytes / 2 bounds the number of windows
    if bytes_ > 4 * most * 8 or n > most:
        return None
    bench = index([tuple(r) for r in benchmark.select(item, text).collect()], span, k)
    return bench if sum(len(b.windows) for b in bench) <= most else None


def mark(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, most: int = MOST) -> DataFrame:
    """For each row of df: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    bench = small(benchmark, item, item_text, span, k, most)
    if bench is None:
        return _joined(df, benchmark, key, text, item, item_text, span, k)
    shared = df.sparkSession.sparkContext.broadcast(bench)

    def run(batches):
        for b in batches:
            rows = _rows(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS))], ["doc_id", *_NAMES])

    return df.select(key, text).mapInArrow(lean(run), f"doc_id {kind}, {_COLUMNS}")


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, most: int = MOST) -> DataFrame:
    """The rows of df, all columns, without those that hold a benchmark window."""
    ship(df.sparkSession)
    bench = small(benchmark, item, item_text, span, k, most)
    if bench is None:
        (row,) = free(df, "row")
        numbered = checkpoint(df.withColumn(row, F.monotonically_increasing_id()))
        bad = _joined(numbered, benchmark, row, text, item, item_text, span, k).where("contaminated").select(F.col("doc_id").alias(row))
        return numbered.join(bad, row, "left_anti").select(*df.columns)
    shared = df.sparkSession.sparkContext.broadcast(bench)
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not r[4] for r in _rows(b.column(at), shared.value)], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)


def _joined(df: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, span: int, k: int) -> DataFrame:
    """mark() for benchmarks of any size, by two joins. Rows are told apart by a number, as ids may repeat."""
    kind = df.schema[key].dataType.simpleString()
    docs = checkpoint(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")))
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))

    def windows(batches):  # (n, words, print, item) of the benchmark
        for b in batches:
            out = []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in index([(name, t)], span, k):
                    for w in {p for c in x.windows.values() for p in c}:
                        out.append((x.n, w.decode(), name))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))], ["n", "words", "item"])

    def item_prints(batches):
        for b in batches:
            out = [(x.n, x.k, p) for t in b.column(1).to_pylist() for x in index([(0, t)], span, k) for p in x.prints.view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["n", "k", "print"])

    known = checkpoint(items.mapInArrow(lean(windows), "n int, words string, item string").distinct())
    prints = checkpoint(items.mapInArrow(lean(item_prints), "n int, k int, print long").distinct())
    shapes = sorted((r.n, r.k) for r in prints.select("n", "k").distinct().collect())  # at most `span` rows

    def doc_prints(batches):
        for b in batches:
            data, offsets = strings(b.column(1))
            for lo, hi in spans(offsets, 1 << 19):
                part = offsets[lo : hi + 1]
                w = scan(data[part[0] : part[-1]], part - part[0])
                rows = np.asarray(b.column(0))[lo:hi]
                for n, gram in shapes:
                    h, valid = bytewords.grams(w.hash, w.doc, gram)
                    at = winnow(h, valid, n - gram + 1)
                    place = at - w.first[w.doc[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[w.doc[at]]), pa.array(np.full(len(at), n, np.int32)), pa.array(place.astype(np.int32)), pa.array(h[at].view(np.int64))], ["row", "n", "place", "print"])

    hit = docs.select("row", "text").mapInArrow(lean(doc_prints), "row long, n int, place int, print long").join(prints.select("n", "print", "k"), ["n", "print"])
    places = hit.groupBy("row").agg(F.collect_set(F.struct("n", "k", "place")).alias("places"))  # at most one text's words

    def around(batches):
        for b in batches:
            out = []
            for row, t, places in zip(*(c.to_pylist() for c in b.columns)):
                data, offsets = strings(pa.array([t], pa.string()))
                w = scan(data, offsets)
                for n in {p["n"] for p in places}:
                    starts = {p["place"] - i for p in places if p["n"] == n for i in range(n - p["k"] + 1)}
                    out += [(row, n, s, phrase(w, s, n).decode()) for s in starts if 0 <= s <= len(w.start) - n]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["row", "n", "start", "words"])

    near = docs.join(places, "row").select("row", "text", "places").mapInArrow(lean(around), "row long, n int, start int, words string")
    near = checkpoint(near.join(known.select("n", "words").distinct(), ["n", "words"]))
    spots = near.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spots"))
    named = near.select("row", "n", "words").distinct().join(known, ["n", "words"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("ids"))

    def close(batches):
        for b in batches:
            rows = []
            for t, spots, ids in zip(*(c.to_pylist() for c in b.columns[1:])):
                data, offsets = strings(pa.array([t], pa.string()))
                n = len(scan(data, offsets).start)
                hit = _mark(n, [(s["start"], s["n"]) for s in spots or ()])
                rows.append((n, hit, len(ids or ()), items_digest(ids or ()), hit > 0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS))], ["doc_id", *_NAMES])

    whole = docs.join(spots, "row", "left").join(named, "row", "left")
    return whole.select("doc_id", "text", "spots", "ids").mapInArrow(lean(close), f"doc_id {kind}, {_COLUMNS}")
