"""Toxicity: weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms, accents, look-alike letters of
other scripts, digits and signs standing for letters, zero-width characters.
The lexicon is learned from labelled rows: word beginnings (the languages
here inflect by suffix) whose presence marks the toxic class.  Hits inside a
learned exception phrase do not count.  The summed weight, alone and divided
by the length of the text, goes through a logistic calibration.

Fitting uses at most `fit_rows` labelled rows (smallest hash of doc_id first);
scoring covers every row.  The lexicon is bounded by `max_entries`, so
shipping it to the tasks is bounded too.

Edge cases: a null or empty text has no hit and gets the score of no hit;
repeated rows are scored one by one; doc_ids labelled twice count as toxic if
any label is; without labelled rows of both classes the lexicon is empty and
every score is the toxic share (0 without rows); extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import any_columns, bounded_batches, pick, read_table, stored

# Letters of other scripts, digits and signs read as Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ɡ": "g", "ӏ": "l", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
    "@": "a", "$": "s", "​": "", "‌": "", "‍": "", "⁠": "",
    "﻿": "", "­": "",
}
TABLE = str.maketrans(LOOK_ALIKES)
WORD = re.compile(r"[^\W\d_]+")
MIN_PREFIX, MAX_PREFIX = 4, 12


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.lower())
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return text.lower().translate(TABLE)


def word_patterns(folded: str) -> set[str]:
    """Beginnings of the distinct words, and whole words (marked by a final space)."""
    out = set()
    for w in set(WORD.findall(folded)):
        out.update(w[:n] for n in range(MIN_PREFIX, min(len(w), MAX_PREFIX) + 1))
        if len(w) >= 3:
            out.add(w + " ")
    return out


@dataclass(frozen=True)
class Lexicon:
    """Patterns (a final space: whole word) with weights, exception phrases
    (two folded words), and the calibration (bias, total, density)."""
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    calibration: tuple[float, float, float] = (-40.0, 0.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for p in lexicon.weights:
            self.automaton.add_word(p.strip(), p.strip())
        if lexicon.weights:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> Iterator[tuple[str, str, str]]:
        """(pattern, phrase with the word before, phrase with the word after) of
        the longest pattern at each word beginning."""
        if not self.lexicon.weights:
            return
        best: dict[int, str] = {}
        weights = self.lexicon.weights
        for end, found in self.automaton.iter(folded):
            start = end - len(found) + 1
            if start and folded[start - 1].isalpha():
                continue
            for p in (found, found + " "):
                if p in weights and (p[-1] != " " or end + 1 == len(folded)
                                     or not folded[end + 1].isalpha()):
                    if len(p) > len(best.get(start, "")):
                        best[start] = p
        for start, p in best.items():
            word = WORD.match(folded, start).group()
            before = WORD.findall(folded[max(0, start - 40):start])
            after = WORD.findall(folded[start + len(word):start + len(word) + 40])
            yield p, f"{before[-1]} {word}" if before else "", f"{word} {after[0]}" if after else ""

    def weight(self, text: str) -> tuple[float, float]:
        """Summed weight of hits outside exceptions; the same per 100 words."""
        folded = fold(text)
        skip = self.lexicon.exceptions
        total = sum(self.lexicon.weights[p] for p, a, b in self.hits(folded)
                    if a not in skip and b not in skip)
        if not total:
            return 0.0, 0.0
        return total, 100 * total / max(1, folded.count(" ") + folded.count("\n") + 1)

    def score(self, text: str) -> float:
        total, density = self.weight(text)
        bias, a, b = self.lexicon.calibration
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, bias + a * math.log1p(total)
                                                  + b * math.log1p(density)))))


def _gain(pos: float, neg: float, n_pos: float, n_neg: float) -> tuple[float, float]:
    """G statistic of presence against class, and the smoothed log odds."""
    share = n_pos / (n_pos + n_neg)
    n, g = pos + neg, 0.0
    if pos:
        g += pos * math.log(pos / (n * share))
    if neg:
        g += neg * math.log(neg / (n * (1 - share)))
    odds = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return 2 * g, odds


def choose_entries(found: dict[int, set[str]], negatives: dict[str, int], n_pos: int,
                   n_neg: int, least_gain: float, max_entries: int,
                   common_share: float = 0.02, common_odds: float = 3.5) -> dict[str, float]:
    """Greedy cover: the strongest pattern first, then the strongest for the
    toxic rows it leaves, so that words which only accompany a chosen pattern
    (as in near copies of one text) are not taken.  Ties: the shorter, then
    the first in order.  Patterns in at least `common_share` of the toxic rows
    with log odds of `common_odds` are too common for that and join them.
    A chosen beginning is lengthened while it keeps 9 of 10 of its rows."""
    holders = defaultdict(set)
    for row, ps in found.items():
        for p in ps:
            holders[p].add(row)
    total = {p: len(rows) for p, rows in holders.items()}
    counts = dict(total)
    longer = defaultdict(list)
    for p in total:
        longer[p[:-1]].append(p)
    chosen: dict[str, float] = {}

    def take(p: str) -> None:
        while p[-1] != " ":
            more = [q for q in longer[p] if q[-1] != " " and total[q] >= 0.9 * total[p]]
            if not more:
                break
            p = more[0]
        chosen[p] = _gain(total[p], negatives.get(p, 0), n_pos, n_neg)[1]

    while counts and len(chosen) < max_entries:
        gain, p = max(((_gain(c, negatives.get(p, 0), n_pos, n_neg)[0], p)
                       for p, c in counts.items()),
                      key=lambda x: (x[0], -len(x[1]), [-ord(ch) for ch in x[1]]))
        if gain < least_gain or _gain(counts[p], negatives.get(p, 0), n_pos, n_neg)[1] <= 0:
            break
        take(p)
        for row in list(holders[p]):
            for q in found[row]:
                counts[q] -= 1
                holders[q].discard(row)
        counts = {q: c for q, c in counts.items() if c > 0}
    for p in sorted(total, key=lambda q: (len(q), q)):
        known = any(p.startswith(q) or q.startswith(p) for q in chosen)
        if (not known and len(chosen) < max_entries and total[p] >= common_share * n_pos
                and _gain(total[p], negatives.get(p, 0), n_pos, n_neg)[1] >= common_odds):
            take(p)
    return chosen


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]),
                               x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def fit_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000,
                least_support: int = 5, least_gain: float = 25.0, max_entries: int = 500,
                max_candidates: int = 20_000) -> Lexicon:
    """Learn from at most `fit_rows` of the labelled rows.  `labels` must hold
    only rows that may be learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = (pick(labels, doc_id="long", toxic="int").dropna()
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = stored(pick(docs, doc_id="long", text="string")
                  .join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows
                  .withColumn("text", F.coalesce("text", F.lit("")))
                  # copies count once, as toxic if one of them is
                  .groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxicity-fit")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sum(n for t, n in sizes.items() if t), sizes.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg)
        return Lexicon(calibration=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))

    def count(batches):
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                (pos if toxic else neg).update(word_patterns(fold(text)))
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_pydict({
                "p": pa.array(keys, pa.string()),
                "pos": pa.array([pos[k] for k in keys], pa.int64()),
                "neg": pa.array([neg[k] for k in keys], pa.int64())})

    share = n_pos / (n_pos + n_neg)
    counted = (rows.mapInArrow(count, "p string, pos long, neg long").groupBy("p")
               .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
               .where((F.col("pos") >= least_support)
                      & (F.col("pos") > 3 * share * (F.col("pos") + F.col("neg")))))
    n = F.col("pos") + F.col("neg")
    gain = (F.col("pos") * F.log(F.col("pos") / (n * share))
            + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))).otherwise(0))
    ranked = counted.orderBy(gain.desc(), "p").limit(max_candidates).collect()
    negatives = {r["p"]: r["neg"] for r in ranked}

    def found(batches):
        for batch in batches:
            ids, ps = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                ids.append(i)
                ps.append([p for p in word_patterns(fold(text)) if p in negatives])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()),
                                              "ps": pa.array(ps, pa.list_(pa.string()))})

    toxic_rows = rows.where("toxic > 0").mapInArrow(found, "doc_id long, ps array<string>")
    weights = choose_entries({k: set(r["ps"]) for k, r in enumerate(toxic_rows.collect())},
                             negatives, n_pos, n_neg, least_gain, max_entries)
    draft = Lexicon(weights)

    def phrases(batches):
        matcher = Matcher(draft)
        for batch in batches:
            out = []
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                seen = {x for _, a, b in matcher.hits(fold(text)) for x in (a, b) if x}
                out += [(x, int(toxic > 0)) for x in seen]
            yield pa.RecordBatch.from_pydict({
                "phrase": pa.array([x for x, _ in out], pa.string()),
                "toxic": pa.array([t for _, t in out], pa.int64())})

    exempt = (rows.mapInArrow(phrases, "phrase string, toxic long").groupBy("phrase")
              .agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
              .where("pos = 0 and n >= 3").orderBy(F.desc("n"), "phrase").limit(max_entries).collect())
    draft = Lexicon(weights, frozenset(r["phrase"] for r in exempt))

    def weigh(batches):
        matcher = Matcher(draft)
        for batch in batches:
            w = [matcher.weight(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_pydict({
                "total": pa.array([x for x, _ in w], pa.float64()),
                "density": pa.array([x for _, x in w], pa.float64()),
                "toxic": batch.column("toxic").cast(pa.int32())})

    features = rows.mapInArrow(weigh, "total double, density double, toxic int").collect()
    x = np.log1p(np.array([[r["total"], r["density"]] for r in features]))
    y = np.array([float(r["toxic"] > 0) for r in features])
    return Lexicon(weights, draft.exceptions, calibrate(x, y))


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, keep: str = "doc_id long") -> DataFrame:
    """Score every row: the columns of `keep` and `score`."""
    bounded_batches(docs.sparkSession)
    names = {c.rsplit(" ", 1)[0]: c.rsplit(" ", 1)[1] for c in keep.split(", ")}

    def score(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            cols = {c: batch.column(c) for c in names}
            cols["score"] = pa.array([matcher.score(t) for t in _texts(batch)], pa.float64())
            yield pa.RecordBatch.from_pydict(cols)

    return pick(docs, **{**names, "text": "string"}).mapInArrow(score, f"{keep}, score double")


def remainder(doc_id, mod: int):
    return F.crc32(doc_id.cast("string")) % mod


def trained_lexicon(spark, docs: DataFrame, sf_dir: str) -> Lexicon:
    """Fitted on the labels whose crc32(doc_id) mod 4 is not 2."""
    labels = read_table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    return fit_lexicon(docs, labels)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity_scores(docs, trained_lexicon(spark, docs, sf_dir)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@any_columns
def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3, with their columns."""
    bounded_batches(spark)
    lexicon = trained_lexicon(spark, docs, sf_dir)
    score = F.pandas_udf(_series_scorer(lexicon), "double")
    return docs.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < 0.3)


def _series_scorer(lexicon: Lexicon):
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon)  # one automaton a task
        for texts in batches:
            yield texts.map(matcher.score)
    return scores
