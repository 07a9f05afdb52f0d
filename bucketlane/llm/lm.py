"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark.

Training takes two passes over the training texts. The first counts words: each task sums what it has read, deals the
sorted (hash, count) runs out by hash range, and each range becomes one sorted array; a word's id is its rank over all
ranges. The second counts n-grams of the model's order, by a hash of their ids and dealt by a hash of their context;
n-grams whose whole context is words so frequent that one range would outgrow the others are dealt by their own hash.
Each range becomes sorted hash arrays: n-grams with their counts, and contexts with what follows them (how many, and how
many n-grams occur once, twice, more often). Then each n-gram counts once for the n-gram without its first word, which
gives the next lower order's counts, dealt and stored alike, down to single words; an n-gram that begins a text, before
which nothing can stand, keeps its own count. The arrays are files in the folder that driver and executors share; workers
map them into memory and look up by binary search, so a model needs no heap and is never collected. Files are written
under another name and renamed, so a task that runs again changes nothing.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. Hashes have 64 bits. Probabilities sum to one
over the vocabulary and one unknown word. Edge cases: null and empty texts are one end; without training texts all words
are unknown and both scores are those of the uniform distribution over one word, 0; repeated rows stay.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketlane.llm import bytewords
from bucketlane.llm.runtime import lean, shared_dir, ship, spans, strings

#: The end's hash, and text bytes that are split at once, and entries that a task holds before it sends them.
END, CHUNK, HELD = 0x5BD1E9955BD1E995, 1 << 20, 1 << 20
#: N-grams that a range should hold, and the order of a model unless another one is asked for.
RANGE, ORDER = 2_000_000, 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed; the first one is ascending and goes as differences."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in (first, *arrays[1:])]
    return len(first).to_bytes(8, "little") + zstandard.compress(b"".join(parts), 1)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(data[:8], "little"), zstandard.decompress(data[8:]), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of each one's values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[at], *(np.add.reduceat(v[order], at) for v in values)]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending, where one of each is, and the number of each item's value."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


class Sums:
    """Running sums by key; `most` bounds what is held before equal keys are put together."""

    def __init__(self, *kinds, most: int = HELD):
        self.kinds, self.most, self.parts, self.held = kinds, most, [], 0

    def add(self, *arrays: np.ndarray) -> None:
        self.parts.append(arrays)
        self.held += len(arrays[0])
        if self.held > 2 * self.most and len(self.parts) > 1:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        whole = [np.concatenate([np.zeros(0, k), *(p[i] for p in self.parts)]).astype(k, copy=False) for i, k in enumerate(self.kinds)]
        whole = summed(*whole)
        self.parts, self.held = [tuple(whole)], len(whole[0])
        return whole

    def clear(self) -> None:
        self.parts, self.held = [], 0


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes the array under its name in one step."""
    part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, os.path.join(folder, f"{name}.npy"))


def load(folder: str, name: str) -> np.ndarray:
    path = os.path.join(folder, f"{name}.npy")
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, ends included, and the first token of each text."""
    w = bytewords.words(data, offsets, bytewords.NOT_SPACE)
    count = np.diff(w.first)
    first = w.first + np.arange(len(w.first))
    out = np.full(len(w.hash) + len(count), np.uint64(END))
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    return out, first


@dataclass
class Model:
    """Where the arrays are and what the driver knows of them."""

    folder: str
    ranges: int
    bases: list[int]
    order: int = ORDER
    n_words: int = 0
    n_tokens: int = 0
    #: Ranges of n-grams by context; as many more hold those of hot contexts.
    parts: int = 1
    #: Ids of hot words; the begin, which has the id after the last word's, is one.
    hot: list[int] = field(default_factory=list)
    #: By order, from single words on.
    discounts: list[tuple] = field(default_factory=list)
    pairs: int = 0
    #: How many words have 1, 2, 3 and 4 different words before them.
    kinds: list[int] = field(default_factory=lambda: [0, 0, 0, 0])

    def word_range(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)

    def id_range(self, ids: np.ndarray) -> np.ndarray:
        """Range of word ids."""
        return np.minimum(np.searchsorted(np.asarray(self.bases[1:]), ids, "right"), self.ranges - 1)

    def deal(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, hash of the context, range) of n-grams, given by columns of ids."""
        context, hot = np.zeros(len(grams[0]), np.uint64), np.ones(len(grams[0]), bool)
        often = np.asarray(self.hot, np.int64)  # ascending, never empty
        for c in grams[:-1]:
            context = _link(context, c)
            hot &= often[np.minimum(np.searchsorted(often, c), len(often) - 1)] == c
        key = _link(context, grams[-1])
        part = ((context >> np.uint64(20)) % np.uint64(self.parts)).astype(np.int64)
        part[hot] = self.parts + ((key[hot] >> np.uint64(20)) % np.uint64(self.parts)).astype(np.int64)
        return key, context, part


def _link(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bytewords.mix(h * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64) + np.uint64(1))


def grams_of(ids: np.ndarray, first: np.ndarray, order: int, begin: int, only_first: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, columns of ids) of the n-grams of texts, one for each token that has as many before it; the begin of the text
    counts as one. only_first: those alone that start with the begin."""
    local = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    at = np.flatnonzero(local == order - 2 if only_first else local >= order - 2)
    return at, [np.where(local[at] >= d, ids[np.maximum(at - d, 0)], begin).astype(np.uint32) for d in range(order - 1, -1, -1)]


class Grams:
    """Running counts of n-grams, given by columns of ids."""

    def __init__(self, model: Model, order: int):
        self.model, self.order, self.parts, self.held = model, order, [], 0

    def add(self, columns: list[np.ndarray], count: np.ndarray) -> None:
        self.parts.append([*columns, count])
        self.held += len(count)
        if self.held > 4 * RANGE and len(self.parts) > 1:
            self.settle()

    def settle(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(columns, counts, hashes, contexts, ranges) of distinct n-grams, by hash."""
        whole = [np.concatenate([np.zeros(0, np.int64 if i == self.order else np.uint32), *(p[i] for p in self.parts)]) for i in range(self.order + 1)]
        key, context, part = self.model.deal(whole[:-1])
        order = np.argsort(key)
        at = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(order) else np.zeros(0, np.int64)
        pick = order[at]
        count = np.add.reduceat(whole[-1][order], at) if len(at) else whole[-1]
        columns = [c[pick] for c in whole[:-1]]
        self.parts, self.held = [[*columns, count]], len(count)
        return columns, count, key[pick], context[pick], part[pick]

    def blocks(self) -> list[tuple[int, int, bytes]]:
        """(order, range, block) of all that is held, which is then forgotten."""
        columns, count, _, _, part = self.settle()
        self.parts, self.held = [], 0
        by = np.argsort(columns[0], kind="stable")  # packing takes ascending ids
        return [(self.order, p, b) for p, b in _deal(part[by], *(c[by] for c in columns), count[by])]


class Reader:
    """Memory-mapped arrays of a model, opened as they are needed."""

    def __init__(self, model: Model):
        self.m, self.files = model, {}

    def __call__(self, name: str) -> np.ndarray:
        if name not in self.files:
            self.files[name] = load(self.m.folder, name)
        return self.files[name]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids, -1 for unknown ones."""
        known, _, back = distinct(h)
        out = np.full(len(known), -1, np.int64)
        part = self.m.word_range(known)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            r = int(part[lo])
            table, some = self(f"word-{r}"), known[lo:hi]
            if len(table):
                at = np.minimum(np.searchsorted(table, some), len(table) - 1)
                out[lo:hi] = np.where(table[at] == some, at + self.m.bases[r], -1)
        return out[back]

    def of_words(self, ids: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Columns of word statistics; 0 for ids of -1."""
        known, _, back = distinct(ids)
        out = [np.zeros(len(known), np.int64) for _ in names]
        real = np.flatnonzero(known >= 0)
        part = self.m.id_range(known[real])
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            r, some = int(part[lo]), real[lo:hi]
            for o, name in zip(out, names):
                o[some] = self(f"{name}-{r}")[known[some] - self.m.bases[r]]
        return [o[back] for o in out]

    def _found(self, part: np.ndarray, key: np.ndarray, keys: str, values: tuple[str, ...]) -> list[np.ndarray]:
        """Values of keys in the files of their ranges, 0 for unknown ones."""
        out = [np.zeros(len(key), np.int64) for _ in values]
        # by range and key, but for the key's last bits
        order = np.argsort(part.astype(np.uint64) << np.uint64(44) | key >> np.uint64(20)) if not len(part) or int(part.max()) < 1 << 20 else np.lexsort((key, part))
        part, key = part[order], key[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            r = int(part[lo])
            table = self(f"{keys}-{r}")
            if len(table):
                at = np.minimum(np.searchsorted(table, key[lo:hi]), len(table) - 1)
                hit = np.flatnonzero(table[at] == key[lo:hi])
                for o, name in zip(out, values):
                    o[order[lo:hi][hit]] = self(f"{name}-{r}")[at[hit]]
        return out

    def grams(self, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(count, [total, n1, n2, n3] of the context) of n-grams."""
        k = len(columns)
        key, context, part = self.m.deal(columns)
        count = self._found(part, key, f"key{k}", (f"count{k}",))[0]
        _, once, back = distinct(context)
        hot = part[once] >= self.m.parts
        names = [[f"{n}{k}" for n in ("total", "n1_", "n2_", "n3_")], [f"hot-{n}{k}" for n in ("total", "n1_", "n2_", "n3_")]]
        stats = [np.zeros(len(once), np.int64) for _ in range(4)]
        for some, keys, values, ranges in ((~hot, f"context{k}", names[0], part), (hot, f"hot-context{k}", names[1], None)):
            which = np.flatnonzero(some)
            h = context[once[which]]
            r = part[once[which]] if ranges is not None else _hot_range(h, self.m.ranges)
            for o, got in zip(stats, self._found(r, h, keys, tuple(values))):
                o[which] = got
        return count, [x[back] for x in stats]


def _hot_range(context: np.ndarray, ranges: int) -> np.ndarray:
    return ((context >> np.uint64(20)) % np.uint64(ranges)).astype(np.int64)


_OPEN: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    """One for each worker and model; those of other models are closed."""
    key = f"{model.folder}/{model.pairs}/{len(model.discounts)}"
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Reader(model)
    return _OPEN[key]


def _texts(batches, column: int = 0):
    """(data, offsets) of about CHUNK bytes."""
    for b in batches:
        data, offsets = strings(b.column(column))
        for lo, hi in spans(offsets, CHUNK):
            part = offsets[lo : hi + 1]
            yield data[part[0] : part[-1]], part - part[0]


_BLOCK, _LEVELS = "part int, block binary", "level int, part int, block binary"


def _blocks(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])


def _levels(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Blocks of several orders; 0 stands for counts of counts, -k for the hot contexts of order k."""
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["level", "part", "block"])


def _deal(part: np.ndarray, *arrays: np.ndarray):
    """Blocks by part, of arrays whose first is ascending within each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(part[lo]), pack(*(a[order[lo:hi]] for a in arrays))


def _per_part(batches, *kinds):
    """(part, sums) of blocks that come ordered by part."""
    now, sums = None, Sums(*kinds, most=2 * RANGE)
    for b in batches:
        for part, block in zip(b.column(0).to_pylist(), b.column(1)):
            if part != now:
                if now is not None:
                    yield now, sums.settle()
                now, _ = part, sums.clear()
            sums.add(*unpack(block.as_py(), *kinds))
    if now is not None:
        yield now, sums.settle()


def _gather(blocks: DataFrame, parts: int, *by: str) -> DataFrame:
    return blocks.repartition(parts, *by).sortWithinPartitions(*by)


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Discounts of counts 0, 1, 2, 3 and more. Where a count of counts is missing, fixed ones that still leave mass."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.0, 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return tuple(min(max(x, 0.05 * i), i - 0.02 * i) if i else 0.0 for i, x in enumerate(d))


def folder_of(spark: SparkSession, folder: str | None) -> str:
    """A new folder that all workers see as a path: below `folder` or spark.checkpoint.dir."""
    base = folder or shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base.removeprefix("file:").lstrip("/")
    if "://" in base:
        raise ValueError(f"{base} can't be mapped into memory; give `folder`, a path mounted on the driver and all executors")
    path = os.path.join(base, f"lm-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def train(texts: DataFrame, folder: str | None = None, order: int = ORDER) -> Model:
    """The model of the single text column of `texts`. order: words of an n-gram, two or more."""
    if order < 2:
        raise ValueError("a model has an order of two or more")
    spark = texts.sparkSession
    ship(spark)
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = Model(folder_of(spark, folder), ranges, [0] * ranges, order)

    def count_words(batches):
        sums = Sums(np.uint64, np.int64)

        def send():
            keys, counts = sums.settle()
            sums.clear()
            return _blocks(list(_deal(model.word_range(keys), keys, counts)))

        for data, offsets in _texts(batches):
            h = tokens(data, offsets)[0]
            sums.add(*np.unique(h, return_counts=True))
            if sums.held > HELD:
                yield send()
        if sums.held:
            yield send()

    def keep_words(batches):
        for part, (keys, counts) in _per_part(batches, np.uint64, np.int64):
            save(model.folder, f"word-{part}", keys)
            save(model.folder, f"freq-{part}", counts)
            top = np.argsort(counts)[-1024:]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(keys)]), pa.array([int(counts.sum())]), pa.array([top.tolist()]), pa.array([counts[top].tolist()])], ["part", "n", "total", "top", "often"])

    # one row for each range, of at most 1024 frequent words each
    made = _gather(texts.mapInArrow(lean(count_words), _BLOCK), ranges, "part").mapInArrow(lean(keep_words), "part long, n long, total long, top array<long>, often array<long>").collect()
    sizes = {r.part: r.n for r in made}
    for part in range(ranges):
        if part not in sizes:
            save(model.folder, f"word-{part}", np.zeros(0, np.uint64))
            save(model.folder, f"freq-{part}", np.zeros(0, np.int64))
    model.bases = [sum(sizes.get(p, 0) for p in range(r)) for r in range(ranges)]
    model.n_words, model.n_tokens = sum(sizes.values()), sum(r.total for r in made)
    if model.n_words >= (1 << 32) - 1:
        raise ValueError("more than 2^32 - 2 distinct words")
    model.parts = max(8, -(-model.n_tokens // RANGE))
    limit = model.n_tokens / (4 * model.parts)
    model.hot = [*sorted(model.bases[r.part] + i for r in made for i, c in zip(r.top, r.often) if c > limit), model.n_words]

    def count_grams(batches):
        read, sums = reader(model), {k: Grams(model, k) for k in range(2, order + 1)}
        for data, offsets in _texts(batches):
            h, first = tokens(data, offsets)
            ids = read.ids(h)
            for k, g in sums.items():
                at, columns = grams_of(ids, first, k, model.n_words, k < order)
                g.add(columns, np.ones(len(at), np.int64))
            if sums[order].held > 2 * HELD:
                yield _levels([b for g in sums.values() for b in g.blocks()])
        if any(g.held for g in sums.values()):
            yield _levels([b for g in sums.values() for b in g.blocks()])

    def keep_grams(k: int):
        """Stores the n-grams of order k, and gives what they say of shorter ones; other blocks pass through."""

        def store(part: int, sums: Grams):
            columns, count, key, context, _ = sums.settle()
            save(model.folder, f"key{k}-{part}", key)
            save(model.folder, f"count{k}-{part}", _narrow(count))
            ctx = summed(context, count, count == 1, count == 2, count > 2)
            rows = [(0, part, np.array([k, *_tally(count)], np.int64).tobytes())]
            if part < model.parts:
                for name, c in zip(("context", "total", "n1_", "n2_", "n3_"), ctx):
                    save(model.folder, f"{name}{k}-{part}", c if name == "context" else _narrow(c.astype(np.int64)))
            else:
                rows += [(-k, p, b) for p, b in _deal(_hot_range(ctx[0], ranges), ctx[0], *(c.astype(np.int64) for c in ctx[1:]))]
            if k > 2:
                shorter = Grams(model, k - 1)
                shorter.add(columns[1:], np.ones(len(count), np.int64))
                return rows + shorter.blocks()
            ends, n = np.unique(columns[1], return_counts=True)
            return rows + [(1, p, b) for p, b in _deal(model.id_range(ends.astype(np.int64)), ends.astype(np.uint64), n.astype(np.int64))]

        def run(batches):
            now, sums = None, Grams(model, k)
            for b in batches:
                through = []
                for level, part, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    if level != k:
                        through.append((level, part, block.as_py()))
                        continue
                    if part != now:
                        if now is not None:
                            yield _levels(store(now, sums))
                        now, sums = part, Grams(model, k)
                    *columns, count = unpack(block.as_py(), *[np.uint32] * k, np.int64)
                    sums.add(columns, count)
                if through:
                    yield _levels(through)
            if now is not None:
                yield _levels(store(now, sums))

        return run

    blocks = texts.mapInArrow(lean(count_grams), _LEVELS)
    for k in range(order, 1, -1):
        blocks = _gather(blocks, 2 * model.parts, "level", "part").mapInArrow(lean(keep_grams(k)), _LEVELS)

    def keep_rest(batches):
        out, now, sums = [], None, None

        def store():
            level, part = now
            keys, *values = sums.settle()
            if level < 0:
                for name, c in zip(("context", "total", "n1_", "n2_", "n3_"), (keys, *values)):
                    save(model.folder, f"hot-{name}{-level}-{part}", c)
                out.append([level, part, 0, 0, 0, 0, 0])
                return
            base = model.bases[part]
            dense = np.zeros((model.bases[part + 1] if part + 1 < ranges else model.n_words) - base, np.int64)
            dense[keys.astype(np.int64) - base] = values[0]
            save(model.folder, f"cont-{part}", _narrow(dense))
            out.append([1, part, int(dense.sum()), *_tally(dense)])

        for b in batches:
            for level, part, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if level == 0:
                    k, *tally = np.frombuffer(block.as_py(), np.int64).tolist()
                    out.append([0, part, k, *tally])
                    continue
                if (level, part) != now:
                    if now is not None:
                        store()
                    now, sums = (level, part), Sums(np.uint64, *[np.int64] * (1 if level == 1 else 4), most=2 * RANGE)
                sums.add(*unpack(block.as_py(), np.uint64, *[np.int64] * (1 if level == 1 else 4)))
        if now is not None:
            store()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], ["level", "part", "total", "c1", "c2", "c3", "c4"])

    # one row of seven numbers for each range and order
    told = _gather(blocks, ranges, "level", "part").mapInArrow(lean(keep_rest), "level long, part long, total long, c1 long, c2 long, c3 long, c4 long").collect()
    here = {(r.total if r.level == 0 else r.level, r.part) for r in told}
    for k in range(2, order + 1):
        for part in range(2 * model.parts):
            if (k, part) not in here:
                for name in ("key", "count", "context", "total", "n1_", "n2_", "n3_"):
                    save(model.folder, f"{name}{k}-{part}", np.zeros(0, np.uint64 if name in ("key", "context") else np.uint8))
        for part in range(ranges):
            if (-k, part) not in here:
                for name in ("context", "total", "n1_", "n2_", "n3_"):
                    save(model.folder, f"hot-{name}{k}-{part}", np.zeros(0, np.uint64 if name == "context" else np.int64))
    for part in range(ranges):
        if (1, part) not in here:
            save(model.folder, f"cont-{part}", np.zeros((model.bases[part + 1] if part + 1 < ranges else model.n_words) - model.bases[part], np.uint8))
    tallies = [[sum(r[i] for r in told if (r.total if r.level == 0 else r.level) == k) for i in range(3, 7)] for k in range(1, order + 1)]
    model.discounts = [discounts(*t) for t in tallies]
    model.pairs = sum(r.total for r in told if r.level == 1)
    model.kinds = tallies[0]
    return model


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as their greatest takes."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def word_probability(model: Model, k: np.ndarray, kinds: tuple[int, int, int]) -> np.ndarray:
    """Continuation probability of words with k different words before them. kinds: words with k = 1, 2, more."""
    if not model.pairs:
        return np.full(len(k), 1 / (model.n_words + 1))
    d = np.asarray(model.discounts[0])
    left = sum(d[i + 1] * kinds[i] for i in range(3)) / model.pairs
    return (k - d[np.minimum(k, 3)]) / model.pairs + left / (model.n_words + 1)


def score_texts(model: Model, read: Reader, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base_score, score) of each text."""
    h, first = tokens(data, offsets)
    ids = read.ids(h)
    c, k = read.of_words(ids, ("freq", "cont"))
    n1_, n2_, _, _ = model.kinds
    p = word_probability(model, k, (n1_, n2_, model.n_words - n1_ - n2_))
    for order in range(2, model.order + 1 if model.pairs else 2):
        at, columns = grams_of(ids, first, order, model.n_words)
        count, (total, n1, n2, n3) = read.grams(columns)
        d, some = np.asarray(model.discounts[order - 1]), total > 0
        at, count, total = at[some], count[some], total[some]
        left = (d[1] * n1[some] + d[2] * n2[some] + d[3] * n3[some]) / total
        p[at] = (count - d[np.minimum(count, 3)]) / total + left * p[at]
    base = np.log10((c + 1) / (model.n_tokens + model.n_words + 1))
    at = first[:-1]
    return np.diff(first), np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of df. One pass, no shuffle."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        read = reader(model)
        for b in batches:
            got = [score_texts(model, read, *t) for t in _texts([b], 1)]
            cols = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0].astype(np.int64)), pa.array(cols[1]), pa.array(np.full(b.num_rows, model.n_tokens, np.int64)), pa.array(cols[2]), pa.array(cols[3])], names)

    return df.select(key, text).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(key: F.Column, parts: int = 7, part: int = 2) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part
