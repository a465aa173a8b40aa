"""From model responses to fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlink.functions.normalize import attribute_key, fiscal_start_month, parse_period, scale_norm, unit_norm, value_norm
from claimlink.functions.text import blank_if_null, strip
from claimlink.sources.schemas import FACT_RESPONSE, RELATION_RESPONSE


def parse_fact_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses (doc_id, chunk_id, page_start, page_end, response) -> (one row for each fact with its ordinal, responses that can't be read)."""
    read = responses.withColumn("r", F.from_json("response", FACT_RESPONSE, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("response").isNull() | F.col("r").isNull() | F.col("r._bad").isNotNull()
    facts = read.where(~bad).select("doc_id", "chunk_id", "page_start", "page_end", F.posexplode(F.coalesce("r.facts", F.array().cast(FACT_RESPONSE["facts"].dataType))).alias("ordinal", "f"))
    return facts.where("f IS NOT NULL").select("doc_id", "chunk_id", "page_start", "page_end", "ordinal", "f.*"), read.where(bad).drop("r")


def parse_relation_responses(responses: DataFrame) -> DataFrame:
    """responses (batch_id, response) -> batch_id, position and the fields of each relation; unreadable responses give none."""
    read = responses.withColumn("r", F.from_json("response", RELATION_RESPONSE))
    return read.select("batch_id", F.posexplode("r.relations").alias("position", "x")).where("x IS NOT NULL").select("batch_id", "position", "x.*")


def fact_id(*parts: str) -> Column:
    """A stable id, so that a rerun writes the same rows."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.col(p).cast("string") for p in parts)), 256), 1, 12)


def fill_period(facts: DataFrame) -> DataFrame:
    """Where an end of a period is missing and its label can be read, both ends come from the label, and the type if there is none."""
    missing = (blank_if_null(F.col("period_start")) == "") | (blank_if_null(F.col("period_end")) == "")
    parsed = F.when(missing & (blank_if_null(F.col("period_label")) != ""), parse_period(F.col("period_label"), fiscal_start_month(F.col("fiscal_year_convention"))))
    out = facts.withColumn("_p", parsed)
    kind = blank_if_null(F.col("period_type"))
    kind = F.when(kind == "", "none").otherwise(kind)
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return out.withColumns({
        "flags": F.when(F.col("_p").isNotNull(), F.array_append(flags, F.lit("period_parsed_by_rule"))).otherwise(flags),
        "period_start": F.coalesce("_p.start", blank_if_null(F.col("period_start"))),
        "period_end": F.coalesce("_p.end", blank_if_null(F.col("period_end"))),
        "period_type": F.when(F.col("_p").isNotNull() & (kind == "none"), F.col("_p.type")).otherwise(kind),
    }).drop("_p")


def finalize_facts(raw: DataFrame, documents: DataFrame) -> DataFrame:
    """raw facts with trimmed fields, defaults, normalised unit, scale, value and period, and the attribute's key.

    documents: doc_id, meta (a struct that has primary_subject and fiscal_year_convention).
    """
    meta = documents.select("doc_id", "meta.primary_subject", "meta.fiscal_year_convention")
    facts = fill_period(raw.join(meta, "doc_id", "left"))
    trimmed = {c: strip(blank_if_null(F.col(c))) for c in ("value_text", "basis", "scope", "quote")}
    known = lambda *texts: F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit("unknown"))
    new = trimmed | {
        "id": fact_id("doc_id", "chunk_id", "ordinal"),
        "kind": F.coalesce(F.nullif("kind", F.lit("")), F.when(F.col("value_num").isNotNull(), "numeric").otherwise("statement")),
        "subject": known(strip(blank_if_null(F.col("subject"))), blank_if_null(F.col("primary_subject"))),
        "attribute_key": attribute_key(F.col("attribute")),
        "unit": unit_norm(F.col("unit")),
        "scale": scale_norm(F.col("scale")),
        "value_norm": value_norm(F.col("value_num"), F.col("scale")),
        "period_label": blank_if_null(F.col("period_label")),
    }
    return facts.withColumns(new).withColumn("attribute", known(strip(blank_if_null(F.col("attribute"))))).drop("primary_subject", "fiscal_year_convention")


