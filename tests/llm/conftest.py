"""Tables with the odd cases every operator must take."""

import random

import pytest

LONG = " ".join(f"word{i % 997}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empties, white space, long texts, repeats and ties."""
    rng = random.Random(5)
    plain = [(i, " ".join(rng.choice("the of and river stone light house".split()) + str(rng.randrange(40))
                          for _ in range(80))) for i in range(10, 30)]
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "x" * 50_000), (None, None), (None, "no id here"),
            (6, "same row"), (6, "same row"), (7, "two texts"), (7, "one id"), (8, "é 🙂 ß\u0000 中文"),
            (9, "one"), *plain, *plain[:3]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2.0) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept int, node string, score double").repartition(4)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def duck_llm():
    import duckdb

    def connect(sf_dir):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        return con
    return connect


@pytest.fixture(scope="session")
def same_as_sql(spark, duck_llm):
    from ridelens.llm import oracle, queries

    def check(name, sf_dir="/root/testdata/sf0.001"):
        got = queries.queries()[name](spark, sf_dir)
        cols = sorted(got.columns)
        want = duck_llm(sf_dir).sql(oracle.oracle_sql()[name])
        assert sorted(want.columns) == cols
        a = sorted(map(tuple, got.select(cols).collect()), key=repr)
        b = sorted(want.project(", ".join(cols)).fetchall(), key=repr)
        assert a == b and a
    return check
