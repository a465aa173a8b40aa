"""Explicit schemas of what is read and written; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _row(text: str) -> T.StructType:
    """A flat schema from its DDL, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in text.split(", "))])


# The fields of documents, facts, relations and of the two kinds of responses.
PAGES = _row("doc_id string, page_no int, text string")
META = _row(
    "title string, publisher string, doc_type string, publication_date string, period_covered_start string, period_covered_end string, fiscal_year_convention string, "
    "default_currency string, default_scale string, primary_subject string, data_vintage_notes string, summary string"
)
DOCUMENTS = _row("doc_id string, filename string, sha256 string, page_count int, status string, error string").add("meta", META).add("created_at", "timestamp").add("finished_at", "timestamp")
RAW_FACT = _row(
    "page int, kind string, subject string, attribute string, value_text string, value_num double, unit string, scale string, period_label string, period_start string, "
    "period_end string, period_type string, basis string, scope string, quote string, confidence double"
)
FACT_RESPONSE = T.StructType().add("facts", T.ArrayType(RAW_FACT)).add("_bad", "string")
RELATION = _row("a string, b string, type string, reconciliation string, confidence double, reasoning string")
RELATION_RESPONSE = T.StructType().add("relations", T.ArrayType(RELATION))
CALLS = _row("doc_id string, purpose string, model string, ok boolean, duration_ms long, cost_usd double, input_tokens long, output_tokens long, error string, created_at timestamp")
RELATION_TYPES = ("corroborates", "contradicts", "reconciled", "unrelated")
RECONCILIATIONS = ("vintage", "definition", "scope", "unit", "estimate_vs_actual", "rounding", "period", "other")
FACT_COLUMNS = (
    "id", "doc_id", "page_no", "chunk_id", "kind", "subject", "attribute", "attribute_key", "value_text", "value_num", "unit", "scale", "value_norm", "period_label",
    "period_start", "period_end", "period_type", "basis", "scope", "quote", "quote_start", "quote_end", "grounding", "grounding_score", "flags", "confidence",
)
