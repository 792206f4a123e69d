"""Interaction audit of document filters.

Every document gets a bit mask of the filters it fails.  All that an audit asks
follows from one table per part of the corpus: how many documents (and how many
good and toxic ones) each of the 2^n coalitions of filters removes.  The step
counts of an order are differences of two coalitions.  Shapley values are the
solution of the least squares problem

    min  sum over coalitions S of w(S) * (removed(S) - sum of phi_i, i in S)^2
    s.t. sum of all phi_i = removed(all filters)

with the Shapley kernel w(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)).  The problem
is linear in `removed`, so its constrained normal equations are solved once, in
rationals, for every unit vector; times n! the solution is a matrix of integers,
which a projection applies to each part's table.  Nothing is rounded.

Documents are only aggregated and joined by Spark, repeated texts are counted
where they are read before they meet, and a part's table has 2^n entries.

Edge cases: a null text is an empty text; a null part is the empty string;
rows with a null doc_id count in every number, but are no copies of others, nor
others of them, and have no labels; rows sharing doc_id and text are not copies
of each other; several label rows of a document mark it if one does; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import pick, read_table

GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("docs", "good", "toxic")


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with matrix @ X = right, by elimination in rationals."""
    n = len(matrix)
    rows = [[*map(Fraction, a), *map(Fraction, b)] for a, b in zip(matrix, right)]
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                factor = rows[r][k]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[k])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """M with phi_i = sum over coalitions S (as bit masks) of M[i][S] * removed(S).

    The last row and column of the equations hold the multiplier of the
    efficiency constraint."""
    everything = (1 << n) - 1
    matrix = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [[Fraction(0)] * (everything + 1) for _ in range(n + 1)]
    for s in range(1, everything):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        for i in range(n):
            if s >> i & 1:
                right[i][s] = weight
                for j in range(n):
                    if s >> j & 1:
                        matrix[i][j] += weight
    for i in range(n):
        matrix[i][n] = matrix[n][i] = Fraction(1)
    right[n][everything] = Fraction(1)
    return solve(matrix, right)[:n]


def integer_weights(n: int) -> list[list[int]]:
    """n! times `shapley_weights`, which are whole numbers."""
    scaled = [[x * factorial(n) for x in row] for row in shapley_weights(n)]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the scaled solution is not integral")
    return [[int(x) for x in row] for row in scaled]


def failure_mask(conditions: list[Column]) -> Column:
    """Bit k is set where condition k holds."""
    mask = F.lit(0)
    for k, condition in enumerate(conditions):
        mask = mask.bitwiseOR(F.when(condition, 1 << k).otherwise(0))
    return mask


def coalition_table(cells: DataFrame, n: int) -> DataFrame:
    """part, total (documents) and, for each count, an array of 2^n entries:
    how many the coalition with that bit mask removes.  `cells`: part, mask and
    the COUNTS, any number of rows per part."""
    masks = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])
    removed = (masks.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
               .groupBy("part", "coalition").agg(F.sum("docs").alias("total"), *[
                   F.sum(F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col(c)).otherwise(0)).alias(c)
                   for c in COUNTS]))
    # 2^n rows a part, whatever the number of documents
    whole = removed.groupBy("part").agg(
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("coalition", *COUNTS))).alias("t"))
    return whole.select("part", "total", *[F.col(f"t.{c}").alias(c) for c in COUNTS])


def audit(cells: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step (see `op12_filter_audit`).
    `names`: one letter a filter, in the order of the mask's bits."""
    n = len(names)
    everything = (1 << n) - 1
    weights = integer_weights(n)

    def weighted(row: list[int]) -> Column:
        return sum((F.col("docs")[s] * w for s, w in enumerate(row) if w), F.lit(0).cast("long"))

    table = coalition_table(cells, n).withColumn("shapley", F.array(*[weighted(r) for r in weights]))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    steps = (table.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))))

    def position(k: Column) -> Column:
        """Where the k-th filter of the order stands among the names, from 1."""
        return F.instr(F.lit(names), F.substr("filter_order", k, F.lit(1)))

    def bit(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), position(k) - 1)

    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda acc, k: F.when(
        k > 0, acc.bitwiseOR(bit(k))).otherwise(acc))
    steps = (steps.withColumns({"before": before, "own": bit(F.col("step"))})
             .withColumn("after", F.col("before").bitwiseOR(F.col("own"))))

    def at(count: str, coalition: Column | str) -> Column:
        return F.get(F.col(count), F.col(coalition) if isinstance(coalition, str) else coalition)

    def here(count: str) -> Column:
        return at(count, "after") - at(count, "before")

    others = F.lit(everything).bitwiseXOR(F.col("own"))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("total") - at("docs", "after")).alias("kept"),
        here("docs").alias("removed"),
        (at("docs", "own") - here("docs")).alias("redundant"),
        (at("docs", F.lit(everything)) - at("docs", others)).alias("unique_fails"),
        here("good").alias("good_lost"), here("toxic").alias("toxic_lost"),
        F.get("shapley", position(F.col("step")) - 1).alias("shapley"))


def text_conditions(text: Column, words: Column) -> list[Column]:
    """A: under 200 words; B: under half of the words are different ones;
    C: more than 2 % of the characters are capitals A-Z; D: a special symbol."""
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]")]


def failure_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask and COUNTS for the four conditions on the text and the fifth,
    E: a document of smaller doc_id has the same text.

    Texts are compared by SHA-256.  Rows with the same text and the same part
    are counted before they meet at their digest, so a text that fills a third
    of the table is a few rows there."""
    read = pick(docs, doc_id="long", text="string", **{part: "string"}).select(
        "doc_id", F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "").alias("words"))
    conditions = text_conditions(F.col("text"), F.col("words"))
    facts = read.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                        failure_mask(conditions).alias("mask"))
    marked = (pick(labels, doc_id="long", quality="int", toxic="int")
              .where("doc_id is not null and (quality = 1 or toxic = 1)")
              .groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                     F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    # rows without an id are dealt by their digest, not all to one task
    keyed = facts.withColumns({"known": F.col("doc_id").isNotNull(),
                               "key": F.coalesce("doc_id", F.xxhash64("digest", "part"))})
    marked = marked.select(F.col("doc_id").alias("key"), F.lit(True).alias("known"), "good", "toxic")
    rows = (keyed.join(marked, ["key", "known"], "left")
            .groupBy("key", "known", "doc_id", "digest", "part", "mask",
                     F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
            .agg(F.count(F.lit(1)).alias("m")))
    per_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("m").alias("n"),
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("m"))).alias("unknown"),
        F.min(F.when(F.col("known"), F.struct("doc_id", "m"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    firsts = F.col("unknown") + F.when(F.col("least.doc_id") == first, F.col("least.m")).otherwise(0)
    copy_bit = 1 << len(conditions)
    split = per_text.withColumn("firsts", firsts).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("firsts").alias("docs")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"),
                 (F.col("n") - F.col("firsts")).alias("docs")))).alias("c"))
    counted = split.where("c.docs > 0").select("part", "good", "toxic", "c.mask", "c.docs")
    return counted.groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.when(F.col("good"), F.col("docs")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("toxic"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Per source, order of the five filters and step: documents kept after it,
    removed at it, failing its filter but removed before, failing no other
    filter, good and toxic ones removed, and 120 times its Shapley value."""
    return audit(failure_cells(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), "ABCDE")
