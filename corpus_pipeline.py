"""Corpus pipeline: five stages over `documents`, each written as Parquet and
reread as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given.  The
first four return the columns of `documents`; the last returns, per document,
its token ids and their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridelens.llm.bpe import stage_bpe
from ridelens.llm.common import read_table, stored
from ridelens.llm.decontaminate import stage_decontaminate
from ridelens.llm.line_dedup import stage_line_dedup
from ridelens.llm.neardup import stage_near_duplicates
from ridelens.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("byte_bpe", stage_bpe),
]

# Lexicon learning, chunk extension and merge rounds have no SQL form: the
# stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
