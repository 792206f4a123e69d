"""Product codes of vectors, trained by ball k-means on exact integers.

A vector is cut into parts and each part is replaced by the number of its
nearest entry in that part position's codebook.  All entries' parts form balls
around them; a round moves the entries and assigns the parts again, from the
assignment before:

* an entry's radius bounds the distance of its parts, so only entries within
  twice the radius are its *neighbours* (the radius of the last round plus the
  way the entry has moved since: no extra pass over the data);
* parts nearer to their entry than half the way to its nearest neighbour are
  its *stable core* and stay without a further distance; so does a whole ball
  if neither its entry nor any neighbour has moved;
* the half ways to the other neighbours cut the rest into *annular rings*: a
  part in the k-th ring can only move to one of the k nearest neighbours, and
  only these distances are taken.

Skipped entries are provably farther, and half ways are compared by squares of
integers, so the result is that of a search over all entries, ties to the lower
index included.  One pass a round over stored rows writes the new codes and each
task's sums; the codebooks (parts x entries, whatever the number of vectors) are
what the driver holds.

Edge cases: rows whose vector is null or holds a null or non-finite component
are dropped; components become floor(256 * x); rows sharing a vec_id are coded
each; a null vec_id is coded but gives no first entry; fewer rows than entries
give smaller codebooks; vectors of another length than that of the smallest
vec_id, or with a component beyond +-16,384 (squares would not fit), are kept
with null code and error; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.common import if_small, pick, read_table, scratch, stored
from ridelens.sources.io import drop_scratch

LARGEST = 1 << 22
INDEX_BITS = 8
ROW_SCHEMA = "vec_id long, label int, x array<int>, codes binary, error long"
SUM_SCHEMA = "part int, entry int, n long, far long, sums array<long>"


@dataclass(frozen=True)
class Balls:
    """One part position's codebook with its balls."""

    entries: np.ndarray   # (k, d)
    order: np.ndarray     # (k, k - 1) the other entries, nearest first
    gaps: np.ndarray      # (k, k - 1) their squared distances
    reach: np.ndarray     # (k,) how many of them are neighbours
    quiet: np.ndarray     # (k,) neither the entry nor a neighbour has moved


def make_balls(entries: np.ndarray, moved: np.ndarray | None = None, radius: list[int] | None = None) -> Balls:
    """`radius`: upper bounds of the distances of the parts now assigned to each
    entry (None: unknown, every entry is a neighbour)."""
    k = len(entries)
    squares = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(squares, -1)
    order = np.argsort(squares, axis=1, kind="stable")[:, 1:]
    gaps = np.take_along_axis(squares, order, 1)
    if radius is None:
        return Balls(entries, order, gaps, np.full(k, k - 1), np.zeros(k, bool))
    reach = np.array([np.searchsorted(gaps[i], (2 * r) ** 2, "right") for i, r in enumerate(radius)])
    quiet = np.array([not moved[i] and not moved[order[i, :reach[i]]].any() for i in range(k)])
    return Balls(entries, order, gaps, reach, quiet)


def assign(x: np.ndarray, start: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of the rows of `x`, now at `start`."""
    own = ((x - balls.entries[start]) ** 2).sum(1)
    best = own << INDEX_BITS | start
    ring, rest = 0, np.flatnonzero(~balls.quiet[start])
    while ring < balls.order.shape[1]:
        at = start[rest]
        rest = rest[(ring < balls.reach[at]) & (balls.gaps[at, ring] <= 4 * own[rest])]
        if not len(rest):
            break
        candidate = balls.order[start[rest], ring]
        away = ((x[rest] - balls.entries[candidate]) ** 2).sum(1)
        best[rest] = np.minimum(best[rest], away << INDEX_BITS | candidate)
        ring += 1
    return best & (1 << INDEX_BITS) - 1, best >> INDEX_BITS


def _ceil_root(n: int) -> int:
    return isqrt(n - 1) + 1 if n > 0 else 0


def _round(rows: DataFrame, books: list[Balls], path: str) -> str:
    """Assign all rows, write them (kind=row) and every task's sums by part and
    entry (kind=sum)."""
    parts, (k, d) = len(books), books[0].entries.shape
    schema = pa.schema([("kind", pa.string()), ("vec_id", pa.int64()), ("label", pa.int32()),
                        ("x", pa.list_(pa.int32())), ("codes", pa.binary()), ("error", pa.int64()),
                        ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("far", pa.int64()),
                        ("sums", pa.list_(pa.int64()))])

    def filled(kind: str, height: int, /, **columns):
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * height) if f.name == "kind" else pa.array(columns[f.name], f.type)
             if f.name in columns else pa.nulls(height, f.type) for f in schema], schema=schema)

    def run(batches):
        sums, counts, far = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            vectors, codes = batch.column("x"), batch.column("codes")
            whole = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
            x = vectors.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(len(whole), parts, d).astype(np.int64)
            old = np.frombuffer(b"".join(codes.take(pa.array(whole)).to_pylist()), np.uint8).reshape(len(whole), parts)
            new, error = np.empty_like(old), np.zeros(len(whole), np.int64)
            for p in range(parts):
                entry, square = assign(x[:, p], old[:, p].astype(np.int64), books[p])
                new[:, p] = entry
                error += square
                counts[p] += np.bincount(entry, minlength=k)
                np.maximum.at(far[p], entry, square)
                for j in range(d):  # exact: a batch's sums are far below 2^53
                    sums[p, :, j] += np.bincount(entry, x[:, p, j], k).astype(np.int64)
            out, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for row, code, e in zip(whole.tolist(), new, error.tolist()):
                out[row], errors[row] = code.tobytes(), e
            yield filled("row", batch.num_rows, vec_id=batch.column("vec_id"), label=batch.column("label"),
                         x=vectors, codes=out, error=errors)
        p, e = np.nonzero(counts)
        yield filled("sum", len(p), part=p, entry=e, n=counts[p, e], far=far[p, e], sums=list(sums[p, e]))

    rows.mapInArrow(run, f"kind string, {ROW_SCHEMA}, {SUM_SCHEMA}").write.partitionBy("kind").parquet(path)
    return path


def _moved_books(spark: SparkSession, path: str, books: list[Balls]) -> list[Balls]:
    """The codebooks after a round: floors of the means, unused entries stay."""
    d = books[0].entries.shape[1]
    used = (spark.read.schema(SUM_SCHEMA).parquet(f"{path}/kind=sum").groupBy("part", "entry")
            .agg(F.sum("n").alias("n"), F.max("far").alias("far"),
                 F.array(*[F.sum(F.col("sums")[j]) for j in range(d)]).alias("sums")).collect())
    entries, radius = [b.entries.copy() for b in books], [[0] * len(b.entries) for b in books]
    for r in used:  # one row per part and entry
        entries[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
        radius[r["part"]][r["entry"]] = _ceil_root(r["far"])
    out = []
    for old, new, reached in zip(books, entries, radius):
        way = ((new - old.entries) ** 2).sum(1)
        out.append(make_balls(new, way > 0, [r + _ceil_root(int(w)) for r, w in zip(reached, way)]))
    return out


def quantised(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, label and x: floor(256 * component), of the rows whose vector is
    whole; x is null where a component is too large."""
    v = pick(vectors, vec_id="long", label="int", **{column: "array<double>"}).withColumnRenamed(column, "_v")
    finite = ~F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    small = F.forall("_v", lambda c: F.abs(c) <= LARGEST / 256)
    return v.where(F.col("_v").isNotNull() & finite).select("vec_id", "label", F.when(
        small, F.transform("_v", lambda c: F.floor(c * 256).cast("int"))).alias("x"))


def vector_codes(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2,
                 column: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of vec_id, label, x, codes, error; the codebooks of the parts).

    `codes` holds one byte per part, so `size` is at most 256.  The codebooks
    start as the parts of the `size` smallest vec_ids."""
    if size > 1 << INDEX_BITS:
        raise ValueError("a codebook has at most 256 entries")
    spark = vectors.sparkSession
    rows = quantised(vectors, column)
    first = [r["x"] for r in rows.where("vec_id is not null and x is not null and size(x) > 0")
             .orderBy("vec_id", "x").select("x").limit(size).collect()]  # at most `size` rows
    if first and len(first[0]) % parts:
        raise ValueError(f"vectors of {len(first[0])} components cannot be cut into {parts} equal parts")
    first = [x for x in first if len(x) == len(first[0])]
    if not first:
        return rows.select("vec_id", "label", "x", F.lit(None).cast("binary").alias("codes"),
                           F.lit(None).cast("long").alias("error")), []
    whole = np.array(first, np.int64).reshape(len(first), parts, -1)
    books = [make_balls(whole[:, p]) for p in range(parts)]
    # everything starts in the ball of entry 0, with an unknown radius
    at = rows.select("vec_id", "label", "x", F.when(F.size("x") == len(first[0]), F.lit(bytes(parts))).alias("codes"))
    path = None
    for _ in range(rounds):
        before, path = path, _round(at, books, scratch(spark, "codes"))
        if before:
            drop_scratch(spark, before)  # its only reader is done
        books = _moved_books(spark, path, books)
        at = spark.read.schema(ROW_SCHEMA).parquet(f"{path}/kind=row")
    last = _round(at, books, scratch(spark, "codes"))
    if path:
        drop_scratch(spark, path)
    return spark.read.schema(ROW_SCHEMA).parquet(f"{last}/kind=row"), [b.entries for b in books]


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    totals = stored(rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(if_small(totals), F.col("label").eqNullSafe(F.col("same")), "left").select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(codebook_digest(books)).alias("codebooks_sha256"))
