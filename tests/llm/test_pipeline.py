import inspect

import corpus_pipeline
from ridelens.llm import bpe, decontaminate, neardup, toxicity
from ridelens.llm.common import read_table

D = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_decisions(spark):
    docs = read_table(spark, D, "documents")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, D)
        rows = out.collect()
        if name != "byte_bpe":
            assert out.columns == columns
        ids = sorted(r["doc_id"] for r in rows)
        before = docs.collect()
        if name == "toxicity":
            lex = toxicity.trained_lexicon(spark, docs, D)
            assert ids == sorted(r["doc_id"] for r in before if toxicity.Matcher(lex).score(r["text"]) < 0.3)
        elif name == "near_duplicates":
            kept = neardup.near_duplicates(docs).where("kept").collect()
            assert ids == sorted(r["doc_id"] for r in kept)
        elif name == "decontamination":
            bad = decontaminate.contamination(docs, read_table(spark, D, "benchmark")).where("contaminated").collect()
            assert ids == sorted({r["doc_id"] for r in before} - {r["doc_id"] for r in bad}) and bad
        elif name == "byte_bpe":
            codec = bpe.Codec(bpe.read_ranks(bpe._public_bpe()[0]), bpe._public_bpe()[1])
            assert {r["doc_id"]: list(r["ids"]) for r in rows} == {
                r["doc_id"]: codec.encode([r["text"]])[0] for r in before}
        else:
            assert ids == sorted(r["doc_id"] for r in before)
        seen.append(name)
        docs = spark.createDataFrame(rows, out.schema)
    assert seen == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert 0 < out.count() < read_table(spark, D, "documents").count()


def test_odd_documents(spark, odd_docs, odd_rows):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, D)
        assert docs.columns == odd_docs.columns
    assert docs.where("doc_id = 1").count() == 1


CLASHING = ["a.b", "_nd_row", "_nd_group", "_ld_lines", "_ld_id", "_ld_spans", "node", "kept", "score", "TEXT2", "digest",
            "component_id", "contaminated", "_id", "`tick`", "column_0"]


def test_columns_of_any_name_come_through(spark):
    """Every stage returns further columns with their names and values."""
    docs = read_table(spark, D, "documents").limit(150)
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, (docs["doc_id"] * 10 + k).cast("int" if k % 2 else "string"))
    assert docs.columns[5:] == CLASHING
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert rows
        for r in rows:
            assert [str(v) for v in r[5:]] == [str(r["doc_id"] * 10 + k) for k in range(len(CLASHING))], name


def test_copies_labelled_both_ways_are_toxic(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(4)] + [(9, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (9, 0)], "doc_id long, toxic int")
    lexicons = [toxicity.fit_lexicon(docs.repartition(n), labels, least_support=1, least_gain=0.0) for n in (1, 3)]
    assert lexicons[0] == lexicons[1]
