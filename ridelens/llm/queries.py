"""One query per operator over its whole table: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridelens.llm.bpe import op7_byte_bpe
from ridelens.llm.decontaminate import op6_decontaminate
from ridelens.llm.filter_audit import op12_filter_audit
from ridelens.llm.html_extract import op2_html_text
from ridelens.llm.line_dedup import op5_line_dedup
from ridelens.llm.neardup import op1_near_duplicates
from ridelens.llm.ngram_model import op3_ngram_score
from ridelens.llm.pii import op4_pii
from ridelens.llm.quality import op10_quality_rules
from ridelens.llm.token_files import op8_token_files
from ridelens.llm.toxicity import op9_toxicity
from ridelens.llm.vector_codes import op11_vector_codes
from ridelens.llm.warc import op13_warc

OPERATORS = (
    op1_near_duplicates,
    op2_html_text,
    op3_ngram_score,
    op4_pii,
    op5_line_dedup,
    op6_decontaminate,
    op7_byte_bpe,
    op8_token_files,
    op9_toxicity,
    op10_quality_rules,
    op11_vector_codes,
    op12_filter_audit,
    op13_warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}
