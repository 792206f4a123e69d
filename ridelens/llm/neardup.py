"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

Documents with equal shingle sets form one class first, so exact copies never
meet each other.  A class has `bands * rows` MinHash samples: bands of them
key the candidate buckets, and all of them are folded into an odd sketch, a
parity bitmap.  The population count of the XOR of two sketches estimates the
similarity; pairs that are below the threshold by more than six standard
errors are dropped, the rest is confirmed on the full shingle sets.

A bucket of up to `pair_bucket` classes emits its pairs.  A larger bucket only
links its members to its first one; where that leaves members of different
components, an exact prefix filter (two sets of similarity t share one of the
(1 - t) rarest shingles of each) finds the remaining pairs, so nothing is
capped and no bucket emits all its pairs.

Edge cases: null, empty and word-less texts have no shingles and are linked
with nothing; fewer words than the shingle length are one shingle; rows
sharing a doc_id are separate documents with one name; a null doc_id is never
the name of a group of others; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import any_columns, bounded_batches, if_small, pick, read_table, stored

WORDS, BANDS, ROWS, SKETCH_BITS = 5, 50, 5, 512
PAIR_BUCKET = 16
# Broadcast bound for tables of one or two numbers a row (16 MB at most).
ID_ROWS = 1_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter((hashes[t] for t in tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    acc = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k]
    return np.unique(mix(acc))


class MinHash:
    def __init__(self, bands: int, rows: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for s in range(0, len(shingles), 1024):
            part = self.a[:, None] * shingles[None, s:s + 1024]
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def band_keys(self, m: np.ndarray) -> np.ndarray:
        """One 64-bit key a band (the band's number goes into it); m: rows of samples."""
        m = m.reshape(len(m), self.bands, self.rows)
        acc = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), m.shape[:2]).copy()
        for k in range(self.rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k])
        return acc.view(np.int64)

    def odd_sketch(self, m: np.ndarray) -> np.ndarray:
        """Parity bitmaps: every sample flips the bit that it hashes to."""
        which = np.arange(m.shape[1], dtype=np.uint64) * MIX2
        bit = (mix(m ^ which) % np.uint64(self.bits)).astype(np.int64)
        flat = (np.arange(len(m))[:, None] * self.bits + bit).ravel()
        odd = np.bincount(flat, minlength=len(m) * self.bits).reshape(len(m), self.bits) & 1
        return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def most_flips(threshold: float, samples: int, bits: int, errors: float = 6.0) -> int:
    """Largest XOR population count that similarity `threshold` can plausibly give:
    the estimate's expectation at `errors` standard errors of MinHash below the
    threshold, and `errors` of the sketch's own above that."""
    low = max(0.0, threshold - errors * math.sqrt(threshold * (1 - threshold) / samples))
    share = (1 - math.exp(-4 * samples * (1 - low) / bits)) / 2
    return min(bits, math.ceil(bits * share + errors * math.sqrt(bits * share * (1 - share)) / 2))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """Per row: doc_id, n_shingles, node (64-bit digest of the set, null if
    empty), bands and sketch (arrays of longs)."""
    bounded_batches(docs.sparkSession)

    def sign(batches):
        hashes, minhash = WordHashes(), MinHash(bands, rows, bits)
        for batch in batches:
            sets = [shingle_set(t.as_py(), hashes) for t in batch.column("text")]
            m = np.stack([minhash.samples(s) for s in sets]) if sets else np.empty((0, bands * rows), np.uint64)
            keys, sketch = minhash.band_keys(m), minhash.odd_sketch(m)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([xxhash.xxh3_128_intdigest(s.tobytes()) % (1 << 63) if len(s) else None
                                  for s in sets], pa.int64()),
                "bands": pa.array(list(keys), pa.list_(pa.int64())),
                "sketch": pa.array(list(sketch), pa.list_(pa.int64()))})

    return pick(docs, doc_id="long", text="string").mapInArrow(
        sign, "doc_id long, n_shingles long, node long, bands array<long>, sketch array<long>")


def shingles_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (sorted array<long>) of the classes in `nodes` (node, first:
    the doc_id that stands for the class)."""
    bounded_batches(docs.sparkSession)

    def load(batches):
        hashes = WordHashes()
        for batch in batches:
            found, wanted = [], batch.column("node").to_pylist()
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), hashes)
                found.append((xxhash.xxh3_128_intdigest(s.tobytes()) % (1 << 63), s.view(np.int64)))
            hits = [(n, s) for (n, s), w in zip(found, wanted) if n == w]  # rows of one doc_id may differ
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([n for n, _ in hits], pa.int64()),
                "shingles": pa.array([s for _, s in hits], pa.list_(pa.int64()))})

    wanted = if_small(nodes.select(F.col("first").alias("doc_id"), "node"), ID_ROWS)
    return (pick(docs, doc_id="long", text="string").join(wanted, "doc_id").select("node", "text")
            .mapInArrow(load, "node long, shingles array<long>").dropDuplicates(["node"]))


def popcount_xor(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda s, x: s + x)


def plausible(pairs: DataFrame, classes: DataFrame, flips: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    side = classes.select("node", "n_shingles", "sketch")
    for name in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                                       F.col("sketch").alias(f"s_{name}")), name)
    return pairs.where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (popcount_xor(F.col("s_a"), F.col("s_b")) <= flips)).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the similarity on their full sets."""
    pairs = stored(pairs, "plausible")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = stored(nodes.join(classes.select("node", "first"), "node"), "needed")
    sets = stored(shingles_of(docs, needed), "shingles")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (pairs.join(a, "a").join(b, "b")
            .where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of all linked nodes, by
    alternating large-star and small-star steps until nothing changes."""
    def with_least(arcs: DataFrame) -> DataFrame:
        return arcs.join(arcs.groupBy("u").agg(F.min("v").alias("m")), "u")

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "edges")
    digest = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (with_least(both).select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("w"))
                 .where("u > w and u <> v").select("u", "v").distinct())
        down = with_least(large)
        small = (down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == digest:
            break
        digest = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def prefix_pairs(hot: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among `hot` (node, comp) that share one of
    their rarest shingles, exact for the similarity `percent`.  In the order by
    rarity, the first common shingle bounds how many can be common, so a pair
    is only made where that bound and the sizes allow the similarity."""
    needed = stored(hot.join(classes.select("node", "first"), "node"), "needed")
    sets = stored(shingles_of(docs, needed), "hot-shingles")
    tokens = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    # shingles held once can match nothing: only the others need a place in the order
    shared = stored(tokens.groupBy("s").count().where("count > 1"), "shared-shingles")
    kept = tokens.join(if_small(shared, ID_ROWS), "s")
    ordered = kept.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("t"))
    # of n shingles, the n - ceil(n * percent / 100) + 1 rarest; the n - size(t) unique ones come first
    alone = F.col("n") - F.size("t")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefix = (ordered.where(length > 0)
              .select("node", "n", alone.alias("alone"),
                      F.posexplode(F.slice("t", 1, length.cast("int"))["s"]).alias("k", "s"))
              # shingles from this one on, itself included: no more can be common if it is the first common one
              .select("node", "n", "s", (F.col("n") - F.col("alone") - F.col("k")).alias("left")).join(hot, "node"))
    prefix = stored(prefix, "prefix")
    per = prefix.groupBy("s", "comp").count()
    main = stored(per.groupBy("s").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"),
                                       F.count("*").alias("k")).where("k > 1").select("s", "main"), "main-components")
    placed = prefix.join(if_small(main, ID_ROWS), "s")
    minor = placed.where("comp <> main").select("s", F.col("node").alias("x"), F.col("comp").alias("comp_x"),
                                                F.col("n").alias("n_x"), F.col("left").alias("left_x"))
    enough = (100 + percent) * F.least("left", "left_x") >= percent * (F.col("n") + F.col("n_x"))
    near = 100 * F.least("n", "n_x") >= percent * F.greatest("n", "n_x")
    return (minor.join(placed, ["s"]).where((F.col("comp") != F.col("comp_x")) & enough & near)
            .select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS,
                    bits: int = SKETCH_BITS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    flips = most_flips(percent / 100, bands * rows, bits)
    rows_ = stored(signatures(docs, bands, rows, bits), "signatures")
    # rows of one class have equal sets, so any row's sketch and bands are the class's
    classes = stored(
        rows_.where("node is not null and doc_id is not null").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows"),
            *[F.any_value(c).alias(c) for c in ("n_shingles", "sketch", "bands")]), "classes")
    keyed = classes.select("node", "first", F.explode("bands").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(
        F.count("*").alias("size"), F.min(F.struct("first", "node"))["node"].alias("leader")).where("size > 1"),
        "buckets")
    members = stored(keyed.join(if_small(buckets, ID_ROWS), "key").select("key", "node", "size", "leader"),
                     "members")
    listed = (members.where(F.col("size") <= pair_bucket).groupBy("key")
              .agg(F.sort_array(F.collect_list("node")).alias("l"))  # at most pair_bucket nodes
              .select("l").distinct())
    small = listed.select(F.explode(F.flatten(F.transform("l", lambda x, i: F.transform(
        F.slice(F.col("l"), i + 2, pair_bucket), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    star = members.where((F.col("size") > pair_bucket) & (F.col("node") != F.col("leader")))
    candidates = small.select("p.a", "p.b").unionByName(
        star.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))).distinct()
    links = stored(confirmed(plausible(candidates, classes, flips, percent), docs, classes, percent), "links")
    comps = stored(components(links), "components")

    crowd = members.where(F.col("size") > pair_bucket).select("key", "node")
    if not crowd.isEmpty():
        placed = crowd.join(comps, "node", "left").select(
            "key", "node", F.coalesce("root", "node").alias("comp"))
        open_keys = stored(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                           .where("lo <> hi").select("key"), "open-buckets")
        hot = stored(placed.join(if_small(open_keys, ID_ROWS), "key", "left_semi")
                     .select("node", "comp").distinct(), "hot")
        more = plausible(prefix_pairs(hot, docs, classes, percent), classes, flips, percent)
        found = stored(confirmed(more, docs, classes, percent), "links")
        if not found.isEmpty():
            # links between components: their members follow through the roots
            comps = stored(components(links.unionByName(found)), "components")
    names = (comps.join(classes.select("node", "first"), "node").groupBy("root")
             .agg(F.min("first").alias("component_id")))
    placed = comps.join(names, "root").select(F.col("node").alias("linked"), "component_id")
    # only classes with a link or with several rows name their rows after another one
    by_node = stored(
        classes.join(placed, F.col("node") == F.col("linked"), "left").where("n_rows > 1 or linked is not null")
        .select("node", F.coalesce("component_id", "first").alias("component_id")), "names")
    out = rows_.select("doc_id", "n_shingles", "node").join(if_small(by_node, ID_ROWS), "node", "left")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", name.alias("component_id"),
                      F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept"))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@any_columns
def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (the smallest doc_id; a null one only where there is
    no other), and all unlinked ones.  Rows are told apart by a number of their
    own, so repeated and null ids are separate documents."""
    numbered = stored(docs.withColumn("_nd_row", F.monotonically_increasing_id()), "numbered")
    found = stored(near_duplicates(numbered.select(F.col("_nd_row").alias("doc_id"), "text"))
                   .select(F.col("doc_id").alias("_nd_row"), F.col("component_id").alias("_nd_group"), "kept"), "groups")
    shared = stored(found.where(~F.col("kept")).select("_nd_group").distinct(), "shared-groups")
    members = stored(found.join(if_small(shared, ID_ROWS), "_nd_group").select("_nd_row", "_nd_group"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"),
                     F.xxhash64("text").alias("digest"), F.col("_nd_row").alias("row"))
    best = (numbered.join(if_small(members, ID_ROWS), "_nd_row").groupBy("_nd_group")
            .agg(F.min(order)["row"].alias("_nd_row")))
    gone = members.join(best, ["_nd_group", "_nd_row"], "left_anti").select("_nd_row")
    return numbered.join(gone, "_nd_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
