"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlink.llm.chat_format import op9_chat_formatting
from claimlink.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from claimlink.llm.factor_quality import op4_quality_classifier
from claimlink.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from claimlink.llm.html_text import op3_html_extraction
from claimlink.llm.jaccard_join import op1_ngram_jaccard_join
from claimlink.llm.mixing import OP13_SQL, op13_source_mixing
from claimlink.llm.packing import op2_best_fit_packing
from claimlink.llm.pieces import op6_sentencepiece
from claimlink.llm.quality_rules import op7_quality_rules
from claimlink.llm.repeats import op8_suffix_array_dedup
from claimlink.llm.topk import OP10_SQL, op10_exact_top_k
from claimlink.llm.url_filter import op5_url_filters

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = (op1_ngram_jaccard_join, op2_best_fit_packing, op3_html_extraction, op4_quality_classifier, op5_url_filters, op6_sentencepiece, op7_quality_rules, op8_suffix_array_dedup, op9_chat_formatting, op10_exact_top_k, op11_conversation_repair, op12_hard_negatives, op13_source_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_top_k": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_source_mixing": OP13_SQL}
