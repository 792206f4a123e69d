"""Quality rules: a threshold table compiled into one Spark projection.

Each rule names a metric and the closed range it must lie in.  All metrics
are built-in array and string functions over one row, so the operator is a
narrow projection: no shuffle, no user function.

Edge cases: a null or empty text has no words, all counts are 0 and it fails
`n_words`; repeated rows are judged one by one; an empty table gives an empty
result; columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import pick

SPACE = "[ \\t-\\r]+"

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au dans de des du en est et la le les par pas pour que qui sur un une "
    "das dem den der die ein eine im ist mit nicht sich und von zu "
    "al como con del el las los no para por se su una y").split()


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    base: bool = False

    def fails(self) -> Column:
        m, bad = F.col(self.metric), F.lit(False)
        if self.least is not None:
            bad = bad | (m < self.least)
        if self.most is not None:
            bad = bad | (m > self.most)
        return bad


RULES = (
    Rule("length", "n_words", least=50, base=True),
    Rule("repeated_words", "repeat_pct", most=50, base=True),
    Rule("word_length_low", "mean_word_chars", least=2.0),
    Rule("word_length_high", "mean_word_chars", most=15.0),
    Rule("symbols", "symbols_per_word", most=0.25),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
)


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs at least twice in the array.

    Windows are compared by 64-bit hash.  Texts without any repeat (most of
    them) end at the distinct count; otherwise the hashes are sorted with
    their positions and equal neighbours are repeats."""
    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)  # evaluates `value` once

    def window_hash(w: Column, x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))

    def hashes(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: window_hash(w, x, i)), 1, F.size(w) - 2)

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"])
                         | (x["g"] == F.get(s, k + 1)["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(
            twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("g"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            bound(F.sort_array(placed), covered))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        bound(words, lambda w: bound(hashes(w), count)))


def metrics(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", text.alias("_text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("_lines"))
    counts = base.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_text", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_n_stop"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("_n_stop") / n).alias("stop_ratio"),
        (100 * F.col("n_repeat_words") / n).alias("repeat_pct"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_line_ratio"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts and ratios, `failed` (names of failed rules),
    `base_failed` and `kept`."""
    m = metrics(pick(docs, doc_id="long", text="string"))
    failed = F.filter(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]),
                      lambda x: x.isNotNull())
    base = F.lit(False)
    for r in rules:
        if r.base:
            base = base | r.fails()
    return m.select(*[c for c in m.columns if not c.startswith("_")],
                    failed.alias("failed"), base.alias("base_failed"),
                    (F.size(failed) == 0).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from ridelens.llm.common import read_table
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
