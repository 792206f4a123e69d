import random
import re

from pyspark.sql import functions as F

from ridelens.llm import decontaminate as D


def toks(t):
    import re
    low = (t or "").translate(str.maketrans(D.UPPER, D.LOWER))
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items, width=13):
    windows = {}
    for i, t in items:
        w = toks(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, ids = toks(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def contaminated_rows(seed=2):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "the", "of", "día", "x1"]
    items = [(k, " ".join(rng.choice(words) + ("" if rng.random() < 0.7 else str(rng.randrange(9)))
                          for _ in range(rng.choice([1, 4, 13, 30])))) for k in range(15)] + [(3, None), (77, " .!")]
    docs = []
    for k in range(120):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            t.insert(rng.randrange(len(t) + 1), rng.choice(items[:15])[1])
        docs.append((k, ", ".join(t)))
    return docs, items


def test_matches_equal_brute_force(spark, odd_rows):
    docs, items = contaminated_rows()
    docs += [(1000 + k, t) for k, (_, t) in enumerate(odd_rows)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got) == sorted(want)


def test_odd_rows_and_empty_tables(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame([(1, "same row"), (2, None)], "item_id long, text string")
    got = D.contamination(odd_docs, items)
    assert got.count() == len(odd_rows)
    assert [r["n_hit"] for r in got.where("doc_id = 6").collect()] == [2, 2]
    assert D.contamination(no_docs, items).count() == 0
    assert D.contamination(odd_docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity_equals_brute_force(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("a b c d e f g h i j".split()) for _ in range(40))) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    terms = spark.createDataFrame([(t, True) for t in "abc"], "term string, anchor boolean")
    index = D.postings(df, terms)
    queries = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["c", "a", "b"]), ("q3", ["b"])],
                                    "query string, terms array<string>")
    got = {(r["query"], r["doc_id"], r["pos"]) for r in D.proximity_matches(index, queries, 3).collect()}
    want = set()
    for q, ts in (("q1", "ab"), ("q2", "cab"), ("q3", "b")):
        for i, t in docs:
            w = t.split()
            for p, x in enumerate(w):
                if x == ts[0] and all(y in w[max(0, p - 3):p + 4] for y in ts[1:]):
                    want.add((q, i, p))
    assert got == want


def test_stage_keeps_clean_documents(spark):
    docs, items = contaminated_rows()
    bad = {r[0] for r in brute(docs, items) if r[4]}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    flagged = D.contamination(df, spark.createDataFrame(items, "item_id long, text string")).where("contaminated")
    assert {r["doc_id"] for r in flagged.collect()} == bad


def test_same_as_sql(same_as_sql):
    same_as_sql("op6_decontaminate")


def test_no_posting_carries_its_document(spark, monkeypatch):
    """With more lookup terms than a broadcast takes, the join shuffles postings
    alone, and results stay the same."""
    monkeypatch.setattr(D, "if_small", lambda df, rows=0: df)
    docs, items = contaminated_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    terms = spark.createDataFrame([("alpha", True)], "term string, anchor boolean")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = D.postings(df, terms)._jdf.queryExecution().executedPlan().toString()
        got = D.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning(term" in plan
    # what leaves the exploding of a text, and so is shuffled, is the posting alone
    assert re.search(r"Generate posexplode.*\), \[doc_id#\d+L, digest#\d+L\], false, \[pos#\d+, term#\d+\]", plan), plan
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got) \
        == sorted(brute(docs, items))


def test_native(spark):
    docs, items = contaminated_rows()
    out = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
