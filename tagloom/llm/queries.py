"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.chat import op1_chat_formatting
from tagloom.llm.decontaminate import op4_decontamination
from tagloom.llm.exact_dedup import op11_exact_dedup
from tagloom.llm.filter_audit import op13_filter_audit
from tagloom.llm.licenses import op5_license_scan
from tagloom.llm.mixing import op3_mixing
from tagloom.llm.nearest import op8_nearest
from tagloom.llm.ngram_join import op7_ngram_jaccard_join
from tagloom.llm.quality import op9_quality
from tagloom.llm.sharding import op6_sharding
from tagloom.llm.spelling import op12_spelling_variants
from tagloom.llm.tokens import op10_token_ids
from tagloom.llm.toxicity import op2_toxicity

OPERATORS = (
    op1_chat_formatting,
    op2_toxicity,
    op3_mixing,
    op4_decontamination,
    op5_license_scan,
    op6_sharding,
    op7_ngram_jaccard_join,
    op8_nearest,
    op9_quality,
    op10_token_ids,
    op11_exact_dedup,
    op12_spelling_variants,
    op13_filter_audit,
)
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {run.__name__: run for run in OPERATORS}
