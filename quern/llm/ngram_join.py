"""N-gram Jaccard join with parity sketches.

Two sets of shingles with sizes a and b and a Jaccard similarity of at least
t = p/q differ in at most (a + b)(q - p)/(q + p) elements.

* Size bands: a pair meets in the band of its larger set. Band j has sets of
  up to BAND_RATIO times its least size, and smaller ones that may still reach
  t with them; d is the most elements that a pair in it may differ in.
* Pigeonhole: shingles fall into m > d + 1 blocks, and the XOR of each block's
  shingle hashes is a key. One differing shingle changes one block, so at least
  m - d blocks of a pair agree. Empty blocks are keys only for sets with at
  least m - d - 1 of them, so a pair has two keys in common at the least.
* Sketch: every shingle flips one of L bits. The Hamming distance of two
  sketches is a lower bound of the symmetric difference.
* Verification counts the shared shingles of both texts.

Equal sets are one class from the start, and a task makes the keys of a class
once. The keys are worked through in slices, so that the disks hold the shuffle
of one slice at a time. Within buckets (classes with a common key) no pairs are
spelled out. Each class is held against the least of its bucket, by sketch, and
what the sketch lets through is verified and makes clusters. Where the others of
a bucket still belong to several clusters they are held against the greatest;
where what remains does, in tiles, a forest of the pairs that the sketch lets
through joins their clusters. So every pair that the sketch lets through lies in
one cluster, and last the clusters that hold several components of links are
compared text by text, in tiles that send on a forest of links. Buckets of more
than HOT classes are split by a second common key, which every pair has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import connected_components, drop, free_names, materialize, quoted, text_key, together
from quern.llm.shingles import mix, shingle_sets

BAND_RATIO = 1.5
#: Bits of a sketch for each shingle of the band's largest set. Fewer let more pairs
#: through to verification; at 2 those differ in an eighth more than they may.
SKETCH_BITS = 2
#: Classes of a bucket that one tile holds on each side, and from which on a bucket is split by second keys.
TILE, HOT = 1024, 2048
#: Classes of a cluster, with their texts, that one tile holds on each side.
TEXTS = 128
#: Parts of the keys that are shuffled one after another.
SLICES = 4
#: Up to so many classes are broadcast to fetch their texts.
BROADCAST_ROWS = 50_000


def _poisson_above(mean: float, n: int) -> float:
    """How likely a Poisson variable exceeds n; by the normal law where the mean is large."""
    if mean > 30:
        return math.erfc((n + 0.5 - mean) / math.sqrt(2 * mean)) / 2
    term = total = math.exp(-mean)
    for i in range(1, n + 1):
        term *= mean / i
        total += term
    return max(1 - total, 0.0)


class Bands:
    """Sizes, blocks and sketch lengths for shingle size k and similarity p/q."""

    def __init__(self, p: int, q: int):
        if not 0 < p < q:
            raise ValueError("the similarity must lie between 0 and 1")
        self.p, self.q = p, q
        #: below this size a linked pair is an equal pair
        self.least = next(n for n in range(1, 1 << 30) if self.differ(n, n + 1) or self.differ(n + 1, n + 1))
        self.starts = [self.least]

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.q - self.p) // (self.q + self.p)

    def start(self, j: int) -> int:
        while len(self.starts) <= j:
            self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] * BAND_RATIO)))
        return self.starts[j]

    def of(self, n: int) -> list[int]:
        """The bands of a set of n shingles: its own, and the next if a larger partner may be there."""
        if n < self.least:
            return []
        j = 0
        while self.start(j + 1) <= n:
            j += 1
        return [j, j + 1] if self.start(j + 1) * self.p <= n * self.q else [j]

    def shape(self, j: int) -> tuple[int, int, int]:
        """(d, m, L) of band j."""
        most = self.start(j + 1) - 1
        low = max(self.least, self.start(j) * self.p // self.q)
        d = self.differ(most, most)
        best = None
        for extra in range(1, d + 10, max(1, d // 200)):
            m = d + 1 + extra
            rare = _poisson_above(m * math.exp(-low / m), extra - 1)
            if best is None or rare < best[0]:
                best = (rare, m)
            if rare <= 1e-4:
                break
        return d, best[1], 64 * math.ceil(SKETCH_BITS * most / 64)


def _keys(shingles: np.ndarray, bands: Bands, shapes: dict) -> list[int]:
    out: list[np.ndarray] = []
    for j in bands.of(len(shingles)):
        if j not in shapes:
            shapes[j] = bands.shape(j)
        d, m, _ = shapes[j]
        block = (mix(shingles ^ np.uint64(0x51ED270B)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        filled, at = np.unique(block[order], return_index=True)
        values = np.bitwise_xor.reduceat(shingles[order], at)
        if m - len(filled) >= m - d - 1:
            empty = np.setdiff1d(np.arange(m), filled)
            filled, values = np.concatenate([filled, empty]), np.concatenate([values, np.zeros(len(empty), np.uint64)])
        with np.errstate(over="ignore"):
            keys = mix(values + mix(filled.astype(np.uint64) * np.uint64(1 << 16) + np.uint64(j)))
        out.append((keys & ~np.uint64(0xFF)) | np.uint64(j % 256))  # the band stays readable
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _sketch(shingles: np.ndarray, length: int) -> bytes:
    bits = np.bincount((mix(shingles ^ np.uint64(0x2545F491)) % np.uint64(length)).astype(np.int64), minlength=length) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _batches(batch: pa.RecordBatch, column: int, chars: int = 1 << 18) -> Iterator[tuple[int, list]]:
    """(first row, texts): a column in parts of about so many characters."""
    start, texts, n = 0, [], 0
    for k in range(batch.num_rows):
        texts.append(batch.column(column)[k].as_py())
        n += len(texts[-1] or "")
        if n >= chars:
            yield start, texts
            start, texts, n = k + 1, [], 0
    if texts:
        yield start, texts


def _prints(sets: list[np.ndarray]) -> list[tuple[int, int] | tuple[None, None]]:
    """128 bits of each set, as two integers; nothing for the empty set."""
    out: list[tuple[int, int] | tuple[None, None]] = []
    with np.errstate(over="ignore"):
        for x in sets:
            n = np.uint64(len(x))
            both = mix(np.array([np.sum(mix(x)) + n, np.sum(mix(x ^ np.uint64(0x7F4A7C15D1B54A32))) - n])).view(np.int64)
            out.append((int(both[0]), int(both[1])) if len(x) else (None, None))
    return out


_SCANNED = "doc_id bigint, t1 bigint, t2 bigint, n_shingles bigint, c1 bigint, c2 bigint, band0 int, sketch0 binary, band1 int, sketch1 binary, " + ", ".join(f"keys{i} array<bigint>" for i in range(SLICES))


def _scan(k: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, shapes = Bands(p, q), {}
        seen: set[tuple] = set()  # classes of this task
        for batch in batches:
            for start, texts in _batches(batch, 3):
                sets = shingle_sets(texts, k)
                prints = _prints(sets)
                fresh = []
                for x in prints:
                    fresh.append(x[0] is not None and x not in seen)
                    seen.add(x)
                keys = [_keys(x, bands, shapes) if new else np.zeros(0, np.int64) for x, new in zip(sets, fresh, strict=True)]
                sketches: list[list] = [[], [], [], []]
                for x, new in zip(sets, fresh, strict=True):
                    at = bands.of(len(x)) if new else []
                    for i in (0, 1):
                        j = at[i] if i < len(at) else None
                        sketches[2 * i].append(None if j is None else j % 256)
                        sketches[2 * i + 1].append(None if j is None else _sketch(x, bands.shape(j)[2]))
                every = np.concatenate(keys)
                of = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
                part = (every >> 8) % SLICES
                lists = []
                for i in range(SLICES):
                    counts = np.bincount(of[part == i], minlength=len(keys))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(every[part == i])))
                whole = [batch.column(i).slice(start, len(texts)) for i in range(3)]
                own = [pa.array([len(x) for x in sets], pa.int64()), *(pa.array([x[i] for x in prints], pa.int64()) for i in (0, 1))]
                kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*whole, *own, *(pa.array(x, kind) for x, kind in zip(sketches, kinds, strict=True)), *lists],
                    names=[x.split()[0] for x in _SCANNED.split(", ")],
                )

    return run


def _close(p: int, q: int):
    """Of pairs with sizes and sketches those that the sketches let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, left, right = (c.to_pylist() for c in batch.columns)
            near = [
                (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= (m + n) * (q - p) // (q + p)
                for m, n, x, y in zip(n_a, n_b, left, right, strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return run


def _verify(k: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, left in _batches(batch, 2):
                right = [batch.column(3)[start + i].as_py() for i in range(len(left))]
                a, b = shingle_sets(left, k), shingle_sets(right, k)
                shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
                linked = pa.array([q * s >= p * (len(x) + len(y) - s) for s, x, y in zip(shared, a, b, strict=True)])
                yield batch.slice(start, len(left)).select([0, 1]).filter(linked)

    return run


def _near_pairs(left: list[tuple], right: list[tuple] | None, p: int, q: int) -> list[tuple]:
    """(distance, a, b, components) of the pairs in different components that the sketches let through.

    Rows are (class, component, size, sketch); without right all pairs of left.
    Few pairs are compared as integers, many as arrays.
    """
    found = []
    other = left if right is None else right
    if len(left) * len(other) <= 256:
        ints = [int.from_bytes(r[3]) for r in left]
        others = ints if right is None else [int.from_bytes(r[3]) for r in other]
        for i, x in enumerate(left):
            for j in range(i + 1 if right is None else 0, len(other)):
                y = other[j]
                if x[1] != y[1]:
                    far = (ints[i] ^ others[j]).bit_count()
                    if far <= (x[2] + y[2]) * (q - p) // (q + p):
                        found.append((far, x[0], y[0], x[1], y[1]))
        return found
    sketches = [np.frombuffer(b"".join(r[3] for r in side), np.uint64).reshape(len(side), -1) for side in (left, other)]
    components = np.array([r[1] for r in other])
    sizes = np.array([r[2] for r in other])
    for i, x in enumerate(left):
        at = np.flatnonzero(components != x[1])
        if right is None:
            at = at[at > i]
        if len(at):
            far = np.bitwise_count(sketches[0][i] ^ sketches[1][at]).sum(axis=1, dtype=np.int64)
            near = far <= (x[2] + sizes[at]) * (q - p) // (q + p)
            found += [(int(h), x[0], other[j][0], x[1], other[j][1]) for h, j in zip(far[near], at[near].tolist(), strict=True)]
    return found


def _forest(pairs: list[tuple]) -> list[tuple]:
    """The pairs that join components, the nearest first."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c] = up.get(up[c], up[c])
        return c

    kept = []
    for pair in sorted(pairs):
        if (a := root(pair[3])) != (b := root(pair[4])):
            up[a] = b
            kept.append(pair)
    return kept


def _tiles(p: int, q: int):
    """Proposes a forest of pairs tile by tile; rows come sorted by tile, whose rows fit in memory."""

    def propose(tile: list[tuple]) -> list[tuple]:
        ti, tj = tile[0][1], tile[0][2]
        rows = sorted(set(tile))
        sides = [[r[4:] for r in rows if r[3] == t] for t in dict.fromkeys((ti, tj))]
        pairs = _near_pairs(sides[0], sides[1] if len(sides) > 1 else None, p, q) if all(sides) else []
        return [(min(x[1], x[2]), max(x[1], x[2])) for x in _forest(pairs)]

    return lambda batches: _by_tile(batches, propose)


def _by_tile(batches: Iterator[pa.RecordBatch], propose: Callable[[list[tuple]], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """What propose() gives for each tile, which is told by the first three columns."""
    tile: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tile and row[:3] != tile[0][:3]:
                out += propose(tile)
                tile = []
            tile.append(row)
        yield _pairs(out)
    yield _pairs(propose(tile) if tile else [])


def _within(k: int, p: int, q: int):
    """A forest of the links between the components of a tile, (cluster, i, j, other, class, component, text) rows sorted by tile.

    Every row that isn't `other` is compared with every one that is.
    """

    def links(tile: list[tuple]) -> list[tuple]:
        rows = sorted({r[3:6]: r for r in tile}.values())
        sets = shingle_sets([r[6] for r in rows], k)
        left = [i for i, r in enumerate(rows) if not r[3]]
        right = [i for i, r in enumerate(rows) if r[3]]
        if not left or not right:
            return []
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids, np.cumsum([len(x) for x in sets])[:-1])
        sizes = np.array([len(sets[i]) for i in right])
        every, starts = np.concatenate([ids[i] for i in right]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        components = np.array([rows[i][5] for i in right])
        mine = np.zeros(len(values), np.int64)
        found = []
        for i in left:
            mine[ids[i]] = 1
            shared = np.add.reduceat(mine[every], starts)
            mine[ids[i]] = 0
            union = sizes + len(ids[i]) - shared
            for j in np.flatnonzero((q * shared >= p * union) & (components != rows[i][5])):
                other = rows[right[j]]
                found.append((int(union[j] - shared[j]), rows[i][4], other[4], rows[i][5], other[5]))
        return [(min(x[1], x[2]), max(x[1], x[2])) for x in _forest(found)]

    return lambda batches: _by_tile(batches, links)


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    found = sorted(set(out))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _ids(spark: SparkSession, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """classes(c1, c2, ...) with id, and twins(c1, ids, first): sets whose first hashes agree, if there are any.

    Keys carry c1 alone; that only matters for two linked sets with one c1, of
    which 2^64 pairs of links hold one. A c1 that stands for several sets gets
    an id for each, so that these aren't taken for one.
    """
    twins = classes.groupBy("c1").agg(F.collect_list(F.xxhash64("c1", "c2")).alias("ids")).filter(F.size("ids") > 1)
    twins = materialize(spark, twins.select("c1", F.array_sort("ids").alias("ids")), "twins")
    if twins.isEmpty():
        drop(spark, twins)
        return classes.withColumn("id", F.col("c1")), None
    both = classes.join(twins, "c1", "left")
    return both.withColumn("id", F.when(F.col("ids").isNull(), F.col("c1")).otherwise(F.xxhash64("c1", "c2"))).drop("ids"), twins


def _texts(spark: SparkSession, read: DataFrame, chosen: DataFrame) -> DataFrame:
    """(class, text) for chosen(class, t1, t2); equal texts come once."""
    if chosen.count() <= BROADCAST_ROWS:
        read = read.join(F.broadcast(chosen.select("t1", "t2").distinct()), ["t1", "t2"], "left_semi")
    once = read.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    return once.join(chosen, ["t1", "t2"]).select("class", "text")


def _buckets(spark: SparkSession, scanned: DataFrame, twins: DataFrame | None) -> DataFrame:
    """(key, class, least) for every key that several classes have, slice by slice."""
    slices = []
    for i in range(SLICES):
        keyed = scanned.filter("c1 is not null").select("c1", F.explode(f"keys{i}").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("c1").alias("least"), F.max("c1").alias("most")).filter("least <> most").drop("most")
        shared = materialize(spark, shared, "shared")
        rows = keyed.join(shared, "key").distinct()
        if twins is not None:
            own, first = twins.select("c1", "ids"), twins.select(F.col("c1").alias("least"), F.get("ids", F.lit(0)).alias("first"))
            rows = rows.join(own, "c1", "left").join(first, "least", "left")
            rows = rows.select("key", F.explode(F.coalesce("ids", F.array("c1"))).alias("c1"), F.coalesce("first", "least").alias("least"))
        slices.append(materialize(spark, rows.select("key", F.col("c1").alias("class"), "least"), "buckets"))
        drop(spark, shared)
    return together(spark, slices)


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, n) of the buckets in rows(key, class, component) that hold several components."""
    found = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    return found.filter("lo <> hi").select("key", "n")


def _split(spark: SparkSession, rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows(key, class, component, n) with the buckets of over HOT classes dealt out by second keys.

    Every pair that may link has two keys of its band in common, so it meets
    again under both. A class goes to as many parts as it has other keys.
    """
    hot = rows.filter(F.col("n") > HOT)
    if hot.isEmpty():
        return rows
    hot_keys = hot.select(F.col("key").alias("second")).distinct().withColumn("also", F.lit(True))
    other = buckets.select("class", F.col("key").alias("second")).join(hot_keys, "second", "left")
    parts = hot.drop("n").join(other, "class").filter("key <> second and pmod(key, 256) = pmod(second, 256) and (also is null or key < second)")
    low = F.lit(0xFF).cast("bigint")
    key = F.xxhash64("key", "second").bitwiseAND(F.lit(~0xFF)).bitwiseOR(F.col("key").bitwiseAND(low))
    parts = materialize(spark, parts.select(key.alias("key"), "class", "component"), "split")
    return rows.filter(F.col("n") <= HOT).unionByName(parts.join(_mixed(parts), "key").select(*rows.columns))


def _rest(spark: SparkSession, clusters: DataFrame, components: DataFrame, fetch: Callable[[DataFrame], DataFrame], k: int, p: int, q: int) -> DataFrame | None:
    """Links between the components within each of clusters(id, component), by comparing texts.

    What isn't in a cluster's largest component is compared with the whole
    cluster, tile by tile; a tile sends on a forest of its links, never pairs.
    """
    own = components.select("id", F.col("component").alias("own"))
    rows = clusters.select("id", F.col("component").alias("cluster")).join(own, "id", "left").select("cluster", F.col("id").alias("class"), F.coalesce("own", "id").alias("component"))
    rows = materialize(spark, rows, "clustered")
    sizes = rows.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "component")).alias("top")
    sizes = sizes.groupBy("cluster").agg(largest, F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    sizes = sizes.select("cluster", F.col("top.component").alias("top"), F.ceil(F.col("all") / TEXTS).cast("int").alias("ends"), F.ceil((F.col("all") - F.col("top.n")) / TEXTS).cast("int").alias("starts"))
    rows = materialize(spark, rows.join(sizes, "cluster"), "rest")
    if rows.isEmpty():
        return None
    texts = fetch(rows.select("class"))
    several = rows.join(texts, "class")

    def side(other: bool, here: str, there: str) -> DataFrame:
        chunk = F.pmod(F.xxhash64("class", F.lit(11)), F.col(here)).cast("int")
        across = F.explode(F.sequence(F.lit(0), F.col(there) - 1))
        both = several.filter(F.lit(True) if other else F.col("component") != F.col("top")).withColumn("across", across)
        i, j = (F.col("across"), chunk) if other else (chunk, F.col("across"))
        return both.select("cluster", i.alias("i"), j.alias("j"), F.lit(other).alias("other"), "class", "component", "text")

    tiles = side(False, "starts", "ends").unionByName(side(True, "ends", "starts"))
    at_tile = ["cluster", "i", "j"]
    found = tiles.repartition(*at_tile).sortWithinPartitions(*at_tile).mapInArrow(_within(k, p, q), "a bigint, b bigint")
    found = materialize(spark, found.distinct(), "links")
    drop(spark, texts)
    return found


def _joined(spark: SparkSession, docs: DataFrame, k: int, p: int, q: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, class, component) for each row of docs; without words class and component are null."""
    read = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).cast("string").alias("text"))
    read = read.select("doc_id", *text_key(F.coalesce("text", F.lit(""))), "text")
    scanned = materialize(spark, read.mapInArrow(_scan(k, p, q), _SCANNED), "shingles")
    read = read.drop("doc_id")

    # c1, c2 tell a set; t1, t2 a text that has it
    classes = scanned.filter("c1 is not null").groupBy("c1", "c2").agg(F.first("t1").alias("t1"), F.first("t2").alias("t2"))
    classes, twins = _ids(spark, materialize(spark, classes, "classes"))
    sets = scanned.select("doc_id", "t1", "t2", "n_shingles", "c1", "c2")
    sketched = [scanned.filter(f"band{i} is not null").select("c1", "c2", F.col(f"band{i}").alias("band"), F.col("n_shingles").alias("size"), F.col(f"sketch{i}").alias("sketch")) for i in (0, 1)]
    sketches = sketched[0].unionByName(sketched[1])
    if twins is not None:
        ids = classes.select("c1", "c2", "id")
        sets, sketches = sets.join(ids, ["c1", "c2"], "left"), sketches.join(ids, ["c1", "c2"])
    else:
        sets, sketches = sets.withColumn("id", F.col("c1")), sketches.withColumn("id", F.col("c1"))
    sets = materialize(spark, sets.select("doc_id", "t1", "t2", "n_shingles", F.col("id").alias("class")), "sets")
    buckets = _buckets(spark, scanned, twins)
    members = buckets.select("class").distinct()
    sketches = sketches.withColumnRenamed("id", "class").join(members, "class", "left_semi")
    sketches = materialize(spark, sketches.groupBy("class", "band", "size").agg(F.first("sketch").alias("sketch")), "sketches")
    drop(spark, scanned)
    classes = classes.select(F.col("id").alias("class"), "t1", "t2")

    def fetch(some: DataFrame) -> DataFrame:
        chosen = materialize(spark, some.join(classes, "class"), "chosen")
        texts = materialize(spark, _texts(spark, read, chosen), "texts")
        drop(spark, chosen)
        return texts

    def verify(pairs: DataFrame) -> DataFrame:
        texts = fetch(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        a, b = (texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        links = materialize(spark, both.mapInArrow(_verify(k, p, q), "a bigint, b bigint"), "links")
        drop(spark, texts)
        return links

    a, b = (sketches.select(F.col("class").alias(c), "band", F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")

    def near(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b, band) that the sketches let through."""
        both = pairs.join(a, ["a", "band"]).join(b, ["b", "band"]).select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        return materialize(spark, both.mapInArrow(_close(p, q), "a bigint, b bigint").distinct(), "near")

    def apart(rows: DataFrame) -> DataFrame:
        """The rows(key, class) of buckets that hold several clusters, with these and the size of the bucket."""
        at = rows.withColumnRenamed("class", "id").join(clusters, "id", "left")
        at = at.select("key", F.col("id").alias("class"), F.coalesce("component", "id").alias("component"))
        return materialize(spark, at.join(materialize(spark, _mixed(at), "mixed"), "key"), "rows")

    def merged(known: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """The components known(id, component) with further edges(a, b): these start from stars, not from all edges anew."""
        stars = known.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return materialize(spark, connected_components(spark, stars.unionByName(edges)), name)

    # each class of a bucket against its least, then the others against the greatest
    band = F.pmod("key", F.lit(256)).cast("int").alias("band")
    joint = near(buckets.filter("class <> least").select(F.col("least").alias("a"), F.col("class").alias("b"), band).distinct())
    links, clusters = verify(joint), materialize(spark, connected_components(spark, joint), "clusters")
    rows = apart(buckets.filter("class <> least").select("key", "class"))
    if not rows.isEmpty():
        most = rows.groupBy("key").agg(F.max("class").alias("most"))
        pairs = rows.join(most, "key").filter("class <> most")
        seconds = pairs.select(F.col("most").alias("a"), F.col("class").alias("b"), "component", band).distinct()
        ends = clusters.select(F.col("id").alias("a"), F.col("component").alias("end"))
        seconds = near(seconds.join(ends, "a", "left").filter(F.coalesce("end", "a") != F.col("component")).select("a", "b", "band"))
        links, clusters = links.unionByName(verify(seconds)), merged(clusters, seconds, "clusters")
        rows = apart(pairs.select("key", "class"))

    # then those that are left against each other, where no cluster holds them yet
    if not rows.isEmpty():
        rows = _split(spark, rows, buckets)
        chunks = F.ceil(F.col("n") / TILE).cast("int")
        rows = rows.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("class", F.lit(7)), chunks).cast("int"), "band": F.pmod("key", F.lit(256)).cast("int")})
        rows = rows.join(sketches, ["class", "band"])
        tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            "key", F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"), "chunk", "class", "component", "size", "sketch"
        )
        at_tile = ["key", "ti", "tj"]
        proposed = tiles.repartition(*at_tile).sortWithinPartitions(*at_tile).mapInArrow(_tiles(p, q), "a bigint, b bigint")
        clusters = merged(clusters, materialize(spark, proposed.distinct(), "proposed"), "clusters")

    components = materialize(spark, connected_components(spark, links), "components")
    more = _rest(spark, clusters, components, fetch, k, p, q)
    if more is not None and not more.isEmpty():
        components = merged(components, more, "components")
    return sets.join(components, sets["class"] == components["id"], "left").select(sets["*"], F.coalesce("component", "class").alias("component"))


def jaccard_components(
    spark: SparkSession, docs: DataFrame, k: int = 5, p: int = 4, q: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a set holds the
    distinct k-word shingles, or the whole text if it has fewer words. Rows
    link when their sets' similarity is at least p/q; component_id is the least
    doc_id that links reach, the own one included.

    Null or wordless texts have no shingles and link with nothing. Rows with
    equal texts, and repeated rows, are in one component; rows that share an id
    but not the text are judged each by its own text. A row without doc_id links
    like others; component_id is null where no linked row has an id. An empty
    table gives an empty result. Other columns of docs aren't read, so their
    names may be anything. Sets and texts are told apart by 128-bit hashes.
    """
    found = materialize(spark, _joined(spark, docs, k, p, q, doc_id, text), "joined")
    least = found.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(
    spark: SparkSession, docs: DataFrame, k: int = 5, p: int = 4, q: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of docs that stand for their component, one for each, with all their columns.

    That is the row of the least doc_id, rows without id last; among several
    texts of that id the one of the least hash. Of rows that agree in id and
    text any single one stays. Rows without words are groups of their own and
    all stay. An empty table gives an empty result; columns may have any names.
    """
    found = materialize(spark, _joined(spark, docs, k, p, q, doc_id, text), "joined")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")
    heads = found.filter("component is not null").groupBy("component").agg(F.min(row).alias("row")).select("row.*")
    n = found.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n"))
    names = free_names(docs, "head_id", "head_t1", "head_t2", "own_t1", "own_t2")
    same = (n["doc_id"].eqNullSafe(heads["doc_id"])) & (n["t1"] == heads["t1"]) & (n["t2"] == heads["t2"])
    heads = materialize(spark, heads.join(n, same).select(heads["doc_id"].alias(names[0]), heads["t1"].alias(names[1]), heads["t2"].alias(names[2]), (n["n"] > 1).alias("many")), "heads")
    bare = found.filter("component is null").select(F.col("doc_id").alias(names[0]), F.col("t1").alias(names[1]), F.col("t2").alias(names[2])).distinct()

    keys = [c.alias(x) for c, x in zip(text_key(F.coalesce(quoted(text).cast("string"), F.lit(""))), names[3:], strict=True)]
    own = docs.select("*", *keys)
    by = quoted(doc_id).cast("bigint").eqNullSafe(F.col(names[0])) & (F.col(names[3]) == F.col(names[1])) & (F.col(names[4]) == F.col(names[2]))
    stay = heads.filter("not many").drop("many").unionByName(bare)
    out = own.join(stay, by, "left_semi").drop(*names[3:])
    many = heads.filter("many").drop("many")
    if many.isEmpty():
        return out
    return out.unionByName(own.join(many, by, "left_semi").dropDuplicates([doc_id, *names[3:]]).drop(*names[3:]))
