import random

import pytest
from pyspark.sql import functions as F

from ridelens.llm import toxicity as T


def test_fold_undoes_disguises():
    assert T.fold("ІDІ0T") == "idiot"
    assert T.fold("i​d1ót") == "idiot"
    assert T.fold("ｓｔｕｐ1ｄ") == "stupid"


def test_matches_word_beginnings_and_exceptions():
    lex = T.Lexicon({"trash": 2.0, "scum ": 3.0}, frozenset({"trash can"}), (-2.0, 2.0, 1.0))
    m = T.Matcher(lex)
    assert m.weight("such trashy scum")[0] == 5.0
    assert m.weight("scummy untrash")[0] == 0
    assert m.weight("the trash can is full")[0] == 0
    assert m.score("7rash scum") > 0.5 > m.score("") == m.score("clean words")
    assert m.weight("trash " + "w " * 100)[1] < m.weight("trash w")[1]


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(3)
    clean = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            words.insert(rng.randrange(60), rng.choice(["blorgs", "blorgish", "grumpf"]))
        elif i % 60 == 1:
            words[10:10] = ["grumpf", "cheese"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learns_prefix_and_exception(learned):
    lex = T.fit_lexicon(*learned)
    assert any(p.startswith("blorg") for p in lex.weights)
    assert any(p.startswith("grump") for p in lex.weights) and "grumpf cheese" in lex.exceptions
    scores = {r["doc_id"]: r["score"] for r in T.toxicity_scores(learned[0], lex).collect()}
    wrong = sum((s >= 0.3) != (i % 6 == 0) for i, s in scores.items())
    assert wrong <= 0.03 * len(scores)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = T.op9_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("acc"),
                F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall")).first()
    assert r["acc"] > 0.95 and r["recall"] > 0.7


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    lex = T.Lexicon({"same": 4.0}, frozenset(), (-2.0, 2.0, 1.0))
    got = T.toxicity_scores(odd_docs, lex).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert T.toxicity_scores(no_docs, lex).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit_lexicon(odd_docs, none).weights == {}
    one_class = spark.createDataFrame([(4, 0), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert T.Matcher(T.fit_lexicon(odd_docs, one_class)).score("same") < 0.3
