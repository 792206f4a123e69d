"""Benchmark decontamination over a distributed positional inverted index.

The training side is indexed by postings (term, document, position).  A test
phrase is looked up from its rarest terms: the posting lists of the two
rarest, each shifted by the term's offset in the phrase, are intersected, and
where they meet the phrase is compared word by word with the document.  A posting
is a term, a document and a position; only documents with a meeting are read
again.  Term rarity is counted over all documents.  Only postings of terms
that are among the two rarest of some phrase are stored, since no lookup
reads others.

Edge cases: null texts have no words; an item without words has no window; an
item of fewer than `width` words is one window; repeated items count as often
as they have different ids; rows sharing a doc_id are told apart by their
text, and equal rows each get the result; an empty benchmark or table gives
no hits; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import any_columns, if_small, pick, read_table, stored

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP),
                    lambda w: w != "")


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, digest (tells rows of one doc_id apart) and text."""
    return pick(docs, doc_id="long", text="string").withColumn("digest", F.xxhash64("text"))


def phrase_windows(items: DataFrame, width: int) -> DataFrame:
    """item (string) and phrase (its words joined by a space), distinct."""
    w = pick(items, item_id="string", text="string").select("item_id", words(F.col("text")).alias("w"))
    n = F.greatest(F.size("w") - width + 1, F.lit(1))
    phrases = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(
        F.slice(F.col("w"), i.cast("int"), width), " "))
    return (w.where(F.size("w") > 0)
            .select(F.col("item_id").alias("item"), F.explode(phrases).alias("phrase")).distinct())


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in all documents of the terms of `vocabulary` (term)."""
    return (_documents(docs).select(F.explode(words(F.col("text"))).alias("term"))
            .join(if_small(vocabulary), "term", "left_semi").groupBy("term").count())


def lookup_plan(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase, its number of words and its two rarest terms with their offsets
    (`second` is null for one-word phrases).  Phrases with a term that no
    document holds cannot occur and are left out."""
    terms = (phrases.select("phrase", F.split("phrase", " ").alias("w"))
             .select("phrase", F.size("w").alias("n"), F.posexplode("w").alias("offset", "term")))
    ranked = (terms.join(if_small(counts), "term").groupBy("phrase", "n")
              .agg(F.sort_array(F.collect_list(F.struct("count", "offset", "term"))).alias("r")))
    return (ranked.where(F.size("r") == F.col("n"))
            .select("phrase", "n", F.get("r", F.lit(0)).alias("first"), F.get("r", F.lit(1)).alias("second")))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: term, anchor, doc_id, digest, pos.  A posting holds no words
    of its document, whichever way the terms are joined."""
    every = (_documents(docs).select("doc_id", "digest", F.posexplode(words(F.col("text"))).alias("pos", "term"))
             .select("doc_id", "digest", "pos", "term"))
    return every.join(if_small(terms), "term").select("term", "anchor", "doc_id", "digest", "pos")


def occurrences(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, digest, start, n, phrase of the candidates (the same columns)
    whose words stand there: only documents that have one are split again."""
    keys = stored(candidates.select(F.col("doc_id").alias("doc_id2"), F.col("digest").alias("digest2")).distinct(),
                  "candidate-documents")
    wanted = candidates.groupBy("doc_id", "digest").agg(
        F.collect_set(F.struct("start", "n", "phrase")).alias("c"))  # at most as many as the document has words
    texts = _documents(docs)
    # two numbers a row may be broadcast; the phrases meet only the texts that are left
    left = texts.join(if_small(keys), texts["doc_id"].eqNullSafe(F.col("doc_id2"))
                      & texts["digest"].eqNullSafe(F.col("digest2"))).drop("doc_id", "digest")
    met = left.join(wanted, F.col("doc_id2").eqNullSafe(F.col("doc_id"))
                    & F.col("digest2").eqNullSafe(F.col("digest"))).select(
        "doc_id", "digest", words(F.col("text")).alias("w"), "c")
    there = F.filter("c", lambda x: F.array_join(F.slice(F.col("w"), x["start"] + 1, x["n"]), " ") == x["phrase"])
    return met.select("doc_id", "digest", F.inline(there)).distinct()


def exact_matches(docs: DataFrame, index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, digest, start, n, phrase of every occurrence of a phrase: where
    the shifted postings of its two rarest terms meet, its words are compared."""
    first = (index.where("anchor").join(if_small(plan.withColumn("term", F.col("first.term"))), "term")
             .select("phrase", "n", "doc_id", "digest", (F.col("pos") - F.col("first.offset")).alias("start"),
                     F.col("second").isNull().alias("alone"))
             .where("start >= 0"))
    second = (index.join(if_small(plan.where("second is not null").select(
        "phrase", F.col("second.term").alias("term"), F.col("second.offset").alias("offset"))), "term")
        .select("phrase", F.col("doc_id").alias("doc_id2"), F.col("digest").alias("digest2"),
                (F.col("pos") - F.col("offset")).alias("start2")))
    same = [first["phrase"] == second["phrase"], first["doc_id"].eqNullSafe(second["doc_id2"]),
            first["digest"].eqNullSafe(second["digest2"]), first["start"] == second["start2"]]
    both = first.join(second, same, "left_semi").unionByName(first.where("alone")).drop("alone")
    return occurrences(docs, stored(both.distinct(), "candidates"))


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """query, doc_id, digest, pos: places of a query's first term from which all
    its other terms stand at most `slop` words away.  `queries`: query, terms
    (array<string>, rarest first); the index must hold their terms.  Positions
    are joined by blocks of `slop` words, so a term meets only its neighbours."""
    width = max(1, slop)
    terms = queries.select("query", F.size(F.array_distinct("terms")).alias("n_terms"),
                           F.posexplode(F.array_distinct("terms")).alias("k", "term"))
    placed = index.join(if_small(terms), "term").select(
        "query", "n_terms", "k", "doc_id", "digest", "pos", F.floor(F.col("pos") / width).alias("block"))
    head = placed.where("k = 0")
    rest = placed.where("k > 0").select(
        "query", "k", "doc_id", "digest", F.col("pos").alias("pos2"),
        F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    near = (head.drop("k").join(rest, ["query", "doc_id", "digest", "block"])
            .where(F.abs(F.col("pos") - F.col("pos2")) <= slop)
            .groupBy("query", "n_terms", "doc_id", "digest", "pos").agg(F.count_distinct("k").alias("found")))
    alone = head.where("n_terms = 1").select("query", "doc_id", "digest", "pos")
    return (near.where(F.col("found") == F.col("n_terms") - 1)
            .select("query", "doc_id", "digest", "pos").unionByName(alone))


def build_index(docs: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, lookup plan) for the phrases (phrase)."""
    vocabulary = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    counts = stored(term_counts(docs, vocabulary), "term-counts")
    plan = stored(lookup_plan(phrases, counts), "lookup-plan")
    terms = (plan.select(F.col("first.term").alias("term"), F.lit(True).alias("anchor"))
             .unionByName(plan.where("second is not null").select(
                 F.col("second.term").alias("term"), F.lit(False).alias("anchor")))
             .groupBy("term").agg(F.max("anchor").alias("anchor")))
    return stored(postings(docs, terms), "postings"), plan


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """Per document: doc_id, digest, n_words, n_hit (words inside an occurrence
    of a benchmark window), items (sorted ids), contaminated."""
    windows = stored(phrase_windows(benchmark, width), "windows")
    phrases = windows.select("phrase").distinct()
    index, plan = build_index(docs, phrases)
    matches = exact_matches(docs, index, plan)
    per_doc = matches.join(if_small(windows), "phrase").groupBy("doc_id", "digest").agg(
        F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("item").alias("items"))
    hits = per_doc.select(
        "doc_id", "digest", F.array_sort("items").alias("items"),
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(
            s["start"], s["start"] + s["n"] - 1))))).cast("long").alias("n_hit"))
    counted = _documents(docs).select("doc_id", "digest",
                                      F.size(words(F.col("text"))).cast("long").alias("n_words"))
    h = hits.withColumnsRenamed({"doc_id": "doc_id2", "digest": "digest2"})
    joined = counted.join(h, counted["doc_id"].eqNullSafe(h["doc_id2"])
                          & counted["digest"].eqNullSafe(h["digest2"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "digest", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@any_columns
def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with their columns."""
    bad = (contamination(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated")
           .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"])
                     & F.xxhash64(docs["text"].cast("string")).eqNullSafe(bad["_digest"]), "left_anti")
