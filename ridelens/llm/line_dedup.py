"""Removal of repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where chunks end,
so the same passage is cut the same way wherever it stands; long lines are
more likely to end a chunk, and a line of more than `min_words` words is a
chunk by itself.  Chunks that occur again anywhere are grouped by hash; the
first occurrence (smallest doc_id, then position) stays.  Around a repeated
chunk the neighbouring lines (on each side up to the line that exceeds
`min_words` words) are compared too, and if chunk and equal neighbours
together hold more than `min_words` words and are equal byte for byte to the
first occurrence, they are removed.

Passages without a common chunk are found by their windows: for every line the
shortest run of lines from it on that exceeds `min_words` words, unless it does
so without that line.  Every passage of more than `min_words` words holds such
a window, whatever its lines are, and each window has a first occurrence of its
own, so a passage is found in whatever surroundings its parts stood before.
Windows that follow each other in both places are joined, and neighbouring
lines equal to those of the first occurrence are removed with them.

Every removed line stands, equal, in an earlier place, so the first copy of a
line always stays.  Shorter repetitions (licence lines, headings) are no
passages and stay, and so do up to `min_words` words beside a passage that
stand so in a later copy but not in the first one.  A window that overlaps its
first occurrence is no copy.

Edge cases: null and empty texts have no chunk and stay as they are; lines
without a word count 0 words; rows equal in doc_id and text count as one
document; a document of removed lines only keeps an empty text; an empty
table gives no rows; other columns pass through whatever their names (those
used here start with `_ld_`).
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import any_columns, bounded_batches, if_small, pick, read_table, stored

MIN_WORDS = 50
CUT_SCALE = 16  # a line of w words ends its chunk with probability w / CUT_SCALE
# Broadcast bound for tables of a few numbers a row.
PLACE_ROWS = 500_000
LINES = "array<struct<h:bigint,w:int>>"
CHUNK_SCHEMA = (f"doc_id long, digest long, k int, line int, h long, lines {LINES}, "
                f"before {LINES}, after {LINES}")


def line_chunks(lines: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(first line, [(hash, words) of its lines]) of each chunk."""
    out, start, current, rolling = [], 0, [], 0
    for i, line in enumerate(lines):
        h, w = xxhash.xxh3_64_intdigest(line) - (1 << 63), len(line.split())
        if w > min_words and current:
            out.append((start, current))
            start, current = i, []
        current.append((h, w))
        rolling = ((rolling << 32) ^ h) & 0xFFFFFFFFFFFFFFFF  # low halves of the last two lines
        if w > min_words or xxhash.xxh3_64_intdigest(rolling.to_bytes(8, "little")) % CUT_SCALE < w:
            out.append((start, current))
            start, current = i + 1, []
    if current:
        out.append((start, current))
    return out


def chunk_table(docs: DataFrame, min_words: int) -> DataFrame:
    """One row a chunk with a word in it: where it stands, its hash, the hashes
    and word counts of its lines and of those before (nearest first) and after."""
    bounded_batches(docs.sparkSession)
    pairs = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("k", pa.int32()), ("line", pa.int32()),
                        ("h", pa.int64()), ("lines", pairs), ("before", pairs), ("after", pairs)])

    def near(flat, order):
        out, total = [], 0
        for i in order:
            out.append(flat[i])
            total += flat[i]["w"]
            if total > min_words:
                break
        return out

    def rows(batch):
        for doc_id, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(),
                                        batch.column("text")):
            chunks = line_chunks((text.as_py() or "").encode().split(b"\n"), min_words)
            flat = [{"h": h, "w": w} for _, c in chunks for h, w in c]
            for k, (line, c) in enumerate(chunks):
                if any(w for _, w in c):
                    joined = b"".join(h.to_bytes(8, "little", signed=True) for h, _ in c)
                    end = line + len(c)
                    yield {"doc_id": doc_id, "digest": digest, "k": k, "line": line,
                           "h": xxhash.xxh3_64_intdigest(joined) - (1 << 63), "lines": flat[line:end],
                           "before": near(flat, range(line - 1, -1, -1)),
                           "after": near(flat, range(end, len(flat)))}

    def cut(batches):
        for batch in batches:
            found = []
            for row in rows(batch):
                found.append(row)
                if len(found) >= 4096:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found = []
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    keyed = pick(docs, doc_id="long", text="string").withColumn("digest", F.xxhash64("text"))
    return keyed.dropna(subset=["text"]).mapInArrow(cut, CHUNK_SCHEMA)


def line_windows(lines: list[bytes], min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(first line, end, hash, lines to compare before, lines to compare after)
    of each shortest run of more than `min_words` words."""
    sums = [0, *accumulate(len(line.split()) for line in lines)]
    hashes = b"".join(xxhash.xxh3_64_digest(line) for line in lines)
    out = []
    for i in range(len(lines)):
        end = bisect_right(sums, sums[i] + min_words)
        if end > len(lines):
            break
        if sums[end] - sums[i + 1] <= min_words:
            before = i - max(0, bisect_right(sums, sums[i] - min_words - 1) - 1)
            after = min(len(lines), bisect_right(sums, sums[end] + min_words)) - end
            out.append((i, end, xxhash.xxh3_64_intdigest(hashes[8 * i:8 * end]) - (1 << 63), before, after))
    return out


def window_table(docs: DataFrame, min_words: int) -> DataFrame:
    """One row a window: where it stands, its hash and how many lines beside it
    are to be compared."""
    bounded_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            found = [(doc_id, digest, *w)
                     for doc_id, digest, text in zip(batch.column("doc_id").to_pylist(),
                                                     batch.column("digest").to_pylist(), batch.column("text"))
                     for w in line_windows(text.as_py().encode().split(b"\n"), min_words)]
            columns = list(zip(*found)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "digest", "start", "end", "h", "n_before", "n_after"])

    keyed = pick(docs, doc_id="long", text="string").withColumn("digest", F.xxhash64("text"))
    return keyed.dropna(subset=["text"]).mapInArrow(
        cut, "doc_id long, digest long, start int, end int, h long, n_before int, n_after int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Later occurrences of windows: columns as of `repeated_regions`, and how
    many lines beside them are to be compared."""
    place = F.struct("doc_id", "digest", "start")
    firsts = stored(windows.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("p")).where("n > 1")
                    .select("h", "p"), "first-windows")
    again = windows.join(if_small(firsts, PLACE_ROWS), "h")
    same_text = F.col("doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("digest") == F.col("p.digest"))
    later = again.where(~(same_text & (F.col("start") < F.col("p.start") + F.col("end") - F.col("start"))))
    return later.select("doc_id", "digest", "start", "end", F.col("p.doc_id").alias("first_id"),
                        F.col("p.digest").alias("first_digest"), F.col("p.start").alias("first_start"),
                        "n_before", "n_after")


def joined_regions(regions: DataFrame) -> DataFrame:
    """Regions that overlap or touch here and in their first occurrences, as one."""
    span = F.struct("start", "end", "n_before", "n_after")
    runs = (regions.groupBy("doc_id", "digest", "first_id", "first_digest",
                            (F.col("start") - F.col("first_start")).alias("shift"))
            .agg(F.sort_array(F.collect_set(span)).alias("found")))

    def joined(done, s):
        last = F.try_element_at(done, F.lit(-1))  # null at first
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
                          last["n_before"].alias("n_before"),
                          F.when(s["end"] > last["end"], s["n_after"]).otherwise(last["n_after"]).alias("n_after"))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(last["end"] >= s["start"], F.concat(rest, F.array(longer))).otherwise(F.concat(done, F.array(s)))
    none = F.array().cast("array<struct<start:int,end:int,n_before:int,n_after:int>>")
    return (runs.withColumn("r", F.explode(F.aggregate("found", none, joined)))
            .select("doc_id", "digest", "r.start", "r.end", "first_id", "first_digest",
                    (F.col("r.start") - F.col("shift")).alias("first_start"), "r.n_before", "r.n_after"))


def _same(a: Column, b: Column) -> Column:
    """How many leading lines are equal."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def _words(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda s, x: s + x["w"])


def repeated_regions(chunks: DataFrame, min_words: int) -> DataFrame:
    """doc_id, digest, start, end (lines) of every later occurrence, with the
    place of the first one: first_id, first_digest, first_start."""
    place = F.struct(F.col("doc_id"), F.col("digest"), F.col("k"))
    # a null doc_id sorts first in a struct, so every occurrence has a place in the order
    firsts = stored(chunks.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("p")).where("n > 1")
                    .select("h", "p"), "firsts")
    again = chunks.join(if_small(firsts, PLACE_ROWS), "h")
    is_first = (F.col("doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("digest") == F.col("p.digest"))
                & (F.col("k") == F.col("p.k")))
    head = again.where(is_first).select(
        "h", F.col("doc_id").alias("first_id"), F.col("digest").alias("first_digest"),
        F.col("line").alias("first_line"), F.col("before").alias("b1"), F.col("after").alias("a1"),
        F.col("lines").alias("l1")).dropDuplicates(["h"])
    both = again.where(~is_first).join(head, "h")
    up = _same(F.col("before"), F.col("b1"))
    down = _same(F.col("after"), F.col("a1"))
    sized = both.withColumns({"up": up, "down": down}).where(F.size("lines") == F.size("l1"))
    total = (_words(F.col("lines")) + _words(F.slice("before", 1, F.col("up")))
             + _words(F.slice("after", 1, F.col("down"))))
    return sized.where(total > min_words).select(
        "doc_id", "digest", (F.col("line") - F.col("up")).alias("start"),
        (F.col("line") + F.size("lines") + F.col("down")).alias("end"),
        "first_id", "first_digest", (F.col("first_line") - F.col("up")).alias("first_start")).distinct()


def equal_regions(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """The regions whose bytes equal those of their first occurrence, with the
    equal ones of the lines to be compared beside them."""
    first_end = F.col("first_start") + F.col("end") - F.col("start")
    beside = ("n_before", "n_after")
    named = stored(regions.withColumns({
        "name": F.concat_ws(":", "doc_id", "digest", "start", "end", *beside),
        "first": F.concat_ws(":", "first_id", "first_digest", "first_start", first_end, *beside)}), "regions")
    asked = (named.select("doc_id", "digest", "start", "end", *beside).unionByName(named.select(
        F.col("first_id").alias("doc_id"), F.col("first_digest").alias("digest"),
        F.col("first_start").alias("start"), first_end.alias("end"), *beside))
        .groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "end", *beside)).alias("asked"))
        .withColumnsRenamed({"doc_id": "id2", "digest": "digest2"}))
    if named.limit(PLACE_ROWS + 1).count() <= PLACE_ROWS:  # four line numbers a region
        asked = F.broadcast(asked)
    texts = pick(docs, doc_id="long", text="string").withColumn("digest", F.xxhash64("text"))
    found = texts.join(asked, texts["doc_id"].eqNullSafe(asked["id2"]) & (texts["digest"] == asked["digest2"]))
    lines = found.select("doc_id", "digest", F.split("text", "\n").alias("l"), F.explode("asked").alias("r"))
    upper = F.greatest(F.col("r.start") - F.col("r.n_before"), F.lit(0))
    bodies = stored(lines.select(
        F.concat_ws(":", "doc_id", "digest", "r.start", "r.end", "r.n_before", "r.n_after").alias("name"),
        F.array_join(F.slice("l", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")), "\n").alias("body"),
        F.reverse(F.slice("l", upper + 1, F.col("r.start") - upper)).alias("before"),
        F.slice("l", F.col("r.end") + 1, F.col("r.n_after")).alias("after"))
        .dropDuplicates(["name"]), "bodies")
    first = bodies.select(F.col("name").alias("first"), F.col("body").alias("first_body"),
                          F.col("before").alias("b1"), F.col("after").alias("a1"))
    return (named.join(bodies, "name").join(first, "first").where(F.col("body") == F.col("first_body"))
            .select("doc_id", "digest", (F.col("start") - _same(F.col("before"), F.col("b1"))).alias("start"),
                    (F.col("end") + _same(F.col("after"), F.col("a1"))).alias("end")))


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with repeated passages removed from `text`, and the new columns
    `_ld_lines`, `_ld_removed` (lines before, lines removed)."""
    chunks = stored(chunk_table(docs, min_words), "chunks")
    windows = stored(window_table(docs, min_words), "windows")
    none = {"n_before": F.lit(0), "n_after": F.lit(0)}
    regions = repeated_regions(chunks, min_words).withColumns(none).unionByName(repeated_windows(windows))
    equal = stored(equal_regions(docs, joined_regions(regions)), "equal")
    removed = (equal.groupBy("doc_id", "digest")
               .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_ld_spans"))
               .withColumnsRenamed({"doc_id": "_ld_id", "digest": "_ld_digest"}))
    if equal.limit(PLACE_ROWS + 1).count() <= PLACE_ROWS:
        removed = F.broadcast(removed)
    text = F.col("text").cast("string")
    joined = docs.join(removed, docs["doc_id"].cast("long").eqNullSafe(F.col("_ld_id"))
                       & F.xxhash64(text).eqNullSafe(F.col("_ld_digest")), "left")
    lines = F.split(text, "\n")

    def keep_rest(spans: Column) -> Column:
        """The lines between the removed spans."""
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(lines)))
        return F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(lines, a + 1, b - a)))
    rest = F.when(F.col("_ld_spans").isNull(), lines).otherwise(
        F.get(F.transform(F.array(merged(F.col("_ld_spans"))), keep_rest), 0))
    return (joined.withColumn("_ld_rest", rest).withColumn("_ld_lines", F.size(lines))
            .withColumn("_ld_removed", F.col("_ld_lines") - F.size("_ld_rest"))
            .withColumn("text", F.when(F.col("_ld_spans").isNull(), text).otherwise(F.array_join("_ld_rest", "\n")))
            .drop("_ld_id", "_ld_digest", "_ld_spans", "_ld_rest"))


def merged(spans: Column) -> Column:
    """Sorted spans without overlap: each starts where the ones before end."""
    zero = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["end"]).alias("upto"),
        F.when(s["end"] <= acc["upto"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
            F.greatest(acc["upto"], s["start"]).alias("start"), s["end"].alias("end"))))).alias("out")))
    return step["out"]


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_passages(pick(read_table(spark, sf_dir, "documents"), doc_id="long", text="string"))
    return out.select("doc_id", "text", F.coalesce("_ld_lines", F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce("_ld_removed", F.lit(0)).cast("long").alias("n_removed"))


@any_columns
def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated passages; `n_chars`
    follows the text."""
    out = remove_passages(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_ld_removed") > 0, F.char_length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
