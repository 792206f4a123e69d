from collections import Counter

from ridelens.llm.quality import RULES, quality_rules


def brute(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = list(zip(words, words[1:], words[2:]))
    many = Counter(grams)
    hit = {k for i, g in enumerate(grams) if many[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit))


def test_counts_equal_brute_force(odd_docs, odd_rows):
    got = quality_rules(odd_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                         "n_repeat_words").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute(t))) for i, t in odd_rows)


def test_repeats_lines_and_symbols(spark):
    texts = ["a b c a b c", "a b c x a b c y", "l one\nl one\n\n \nl two\n", "# * $ % & | < > x", "a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t)


def test_rules_name_what_failed(spark):
    junk = " ".join(f"w{i} | $$$" for i in range(60))
    row = quality_rules(spark.createDataFrame([(1, junk)], "doc_id long, text string")).first()
    assert "symbols" in row["failed"] and "stop_words" in row["failed"] and not row["kept"]
    assert {r.name for r in RULES if r.base} == {"length", "repeated_words"}


def test_one_projection_without_python_or_shuffle(odd_docs):
    plan = quality_rules(odd_docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_empty_table(no_docs):
    assert quality_rules(no_docs).count() == 0


def test_same_as_sql(same_as_sql):
    same_as_sql("op10_quality_rules")
