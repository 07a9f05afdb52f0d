"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints have 64 bits, in 32 segments of two. The embedding of a fingerprint is the vector of its segments' bit
counts; the Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. The range join
(Manhattan distance up to `radius`) works on grids of unit cells: the 32 coordinates are cut into 2 * radius runs, and two
vectors that near each other agree on at least `radius` whole runs; so, for each choice of `radius` runs there is one grid over
their coordinates, and each pair in range shares a cell of at least one grid. Pairs of a cell are then held against the
Hamming distance itself.

Equal fingerprints are one point, however many documents have them. A cell gives a spanning forest of its links and
never its pairs. Cells of more than `most` points are cut into chunks whose pairs of chunks are dealt to many tasks, so
no task ever gets more than about 2 * `most` points of a cell. Classes come from the links by alternating large-star and
small-star steps, with a checkpoint each.

Edge cases: null and empty texts, and texts of white space alone, have fingerprint zero, which links like any other;
fewer than `k` words form one shingle; repeated rows stay; a row whose doc_id is null belongs to its fingerprint's class
and takes part in naming it only if no other row does (component_id is then null); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketlane.llm import bytewords
from bucketlane.llm.runtime import checkpoint, free, lean, ship, spans, strings

SEED, K, RADIUS, MOST = 42, 3, 3, 4096
_EVEN = 0x5555555555555555


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, k: int = K) -> np.ndarray:
    """Fingerprints of many texts as uint64."""
    w = bytewords.words(data, offsets, bytewords.NOT_SPACE, hashed=False)
    n_docs, count = len(offsets) - 1, np.diff(w.first)
    out = np.zeros(n_docs, np.uint64)
    if not len(w.start):
        return out
    size = w.end - w.start
    # words joined by single blanks
    to = np.cumsum(size + 1) - (size + 1)
    flat = np.full(int(to[-1] + size[-1]), 32, np.uint8)
    inside = bytewords.NOT_SPACE[w.data]
    flat[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = w.data[inside]
    shingles = np.where(count > 0, np.maximum(1, count - k + 1), 0)
    base = np.cumsum(shingles) - shingles
    total = int(shingles.sum())
    first = np.repeat(w.first[:-1] - base, shingles) + np.arange(total)
    last = np.minimum(first + k - 1, np.repeat(w.first[1:] - 1, shingles))
    view, digest = flat.tobytes(), xxhash.xxh64_intdigest
    lo, hi = to[first].tolist(), (to[last] + size[last]).tolist()
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(lo, hi)), np.uint64, total)
    full = np.flatnonzero(shingles)
    starts = base[full]
    ones = np.empty((len(full), 64), np.int64)
    little = h.astype("<u8").view(np.uint8).reshape(total, 8)
    for byte in range(8):
        bits = np.unpackbits(little[:, byte : byte + 1], axis=1, bitorder="little")
        ones[:, byte * 8 : byte * 8 + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    bits = (2 * ones > shingles[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's bits as a signed long."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = strings(b.column(1))
            got = [np.zeros(0, np.uint64)]
            for lo, hi in spans(offsets, 1 << 19):
                part = offsets[lo : hi + 1]
                got.append(fingerprints_of(data[part[0] : part[-1]], part - part[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got).view(np.int64))], ["doc_id", "fp"])

    return df.select(key, text).mapInArrow(lean(run), f"doc_id {df.schema[key].dataType.simpleString()}, fp long")


def grids(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask for each grid: two bits for each coordinate that it uses."""
    runs = 2 * radius
    cuts = [32 * i // runs for i in range(runs + 1)]
    mask = [sum(3 << (2 * s) for s in range(cuts[i], cuts[i + 1])) for i in range(runs)]
    return [sum(mask[i] for i in c) for c in combinations(range(runs), radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: F.Column) -> F.Column:
    """All 32 bit counts, in two bits each."""
    low, high = fp, F.shiftrightunsigned(fp, 1)
    one, two = low.bitwiseXOR(high).bitwiseAND(F.lit(_EVEN)), low.bitwiseAND(high).bitwiseAND(F.lit(_EVEN))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _forest(fp: np.ndarray, side: np.ndarray | None, radius: int, block: int = 256) -> list[tuple[int, int]]:
    """Links that connect what the pairs within `radius` connect. side: given, only pairs across the sides count."""
    n, u, links = len(fp), fp.view(np.uint64), []
    label = np.arange(n)
    for lo in range(0, n, block):
        near = np.bitwise_count(u[lo : lo + block, None] ^ u[None, :]) <= radius
        if side is not None:
            near &= side[lo : lo + block, None] != side[None, :]
        for x in np.flatnonzero(near.sum(1) > (side is None)).tolist():
            i, beside = lo + x, np.flatnonzero(near[x])
            other = beside[label[beside] != label[i]]
            while len(other):
                j = int(other[0])
                links.append((int(fp[i]), int(fp[j])))
                label[label == label[j]] = label[i]
                other = other[label[other] != label[i]]
    return links


def links(points: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within `radius`."""
    ship(points.sparkSession)
    e = embedding(F.col("fp"))
    cells = F.array(*(F.struct(F.lit(i).alias("grid"), e.bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(grids(radius))))
    # each point becomes a row for each grid, so they are dealt to as many tasks as later shuffles have
    dealt_ = points.select("fp").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = dealt_.select("fp", F.explode(cells).alias("c")).select("c.grid", "c.cell", "fp")
    full = rows.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = rows.join(full, ["grid", "cell"])
    # a cell of more than `most` points: chunk i goes to the tiles (i, j) of every j
    chunks = F.ceil(F.col("n") / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    tiles = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiled = (
        shared.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(tiles))
        .select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )
    dealt = tiled.repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j", "fp")

    def run(batches):
        kept: list[np.ndarray] | None = None

        def solve(part: list[np.ndarray]):
            _, _, i, j, own, fp = part
            two = i[0] != j[0]
            return _forest(fp, own if two else None, radius)

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            n = len(cols[0])
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            found = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if hi - lo == 2:  # nearly all cells
                    x, y = int(cols[5][lo]), int(cols[5][lo + 1])
                    if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius and not (cols[2][lo] != cols[3][lo] and cols[4][lo] == cols[4][lo + 1]):
                        found.append((x, y))
                elif hi - lo > 2:
                    found += solve([c[lo:hi] for c in cols])
            kept = [c[at[-1] :].copy() for c in cols]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
        if kept is not None and (found := solve(kept)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """(node, root): root is the least node of each class, for the nodes that edges (a, b) name. Alternates large-star
    (each node's larger neighbours link to the least one) and small-star until nothing changes."""
    now = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(steps):
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a != b").distinct()
        now = checkpoint(small)
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"classes are not stable after {steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(doc_id, fp, component_id) for each row of df."""
    prints = checkpoint(fingerprints(df, key, text))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = links(points.select("fp"), radius, most)
    classes = checkpoint(components(found))
    named = points.join(classes, points.fp == classes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(of_print, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of df, one for each class: that of the least doc_id, nulls last; of several such rows any one. Ids that are
    null or occur twice don't tell rows apart, so rows are numbered then."""
    if not df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").limit(1).count():
        kept = near_duplicates(df, key, text, radius).where("doc_id = component_id").select(F.col("doc_id").alias(key))
        return df.join(kept, key, "left_semi").select(*df.columns)
    (row,) = free(df, "row")
    numbered = checkpoint(df.withColumn(row, F.monotonically_increasing_id()))
    classes = near_duplicates(numbered, row, text, radius).select(F.col("doc_id").alias("n"), "component_id")
    ids = numbered.select(F.col(row).alias("n"), F.col(key).alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), "n"))
    kept = classes.join(ids, "n").groupBy("component_id").agg(first.alias("first")).select(F.col("first.n").alias(row))
    return numbered.join(kept, row, "left_semi").select(*df.columns)
