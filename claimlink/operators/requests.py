"""The texts that go to an external extractor or judge, as rows. The calls themselves are no data work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlink.functions.text import blank_if_null

#: What a request says about its document, in this order.
CONTEXT_KEYS = ("title", "publisher", "doc_type", "publication_date", "period_covered_start", "period_covered_end", "fiscal_year_convention", "default_currency", "default_scale", "primary_subject", "data_vintage_notes")


def or_else(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def doc_context(meta: Column) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"- {k}: "), or_else(meta[k], "(unknown)")) for k in CONTEXT_KEYS))


# The headings and the layout of requests are part of what must come out.


def doc_meta_requests(pages: DataFrame, documents: DataFrame, head_pages: int = 4, head_chars: int = 6000, tail_chars: int = 3000) -> DataFrame:
    """(doc_id, prompt): a document's first pages, and its last if it isn't among them. Only these pages are gathered."""
    wide = pages.join(documents.select("doc_id", "filename", "page_count"), "doc_id")
    wide = wide.where((F.length("text") > 0) & ((F.col("page_no") <= head_pages) | (F.col("page_no") == F.col("page_count"))))
    head = F.col("page_no") <= head_pages
    shown = F.concat(F.lit("[[page "), F.col("page_no").cast("string"), F.lit("]]\n"), F.when(head, F.left("text", F.lit(head_chars))).otherwise(F.left("text", F.lit(tail_chars))))
    parts = wide.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(head, F.struct("page_no", shown.alias("t"))))).alias("h"), F.max(F.when(~head, shown)).alias("tail"))
    made = documents.select("doc_id", "filename", "page_count").join(parts, "doc_id", "left")
    prompt = F.concat(F.lit("Filename: "), "filename", F.lit("\nTotal pages: "), F.col("page_count").cast("string"), F.lit("\n\n=== FIRST PAGES ===\n"), F.coalesce(F.array_join("h.t", "\n\n"), F.lit("")), F.lit("\n\n=== LAST PAGE ===\n"), blank_if_null(F.col("tail")))
    return made.select("doc_id", prompt.alias("prompt"))


def extraction_requests(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, context, prompt): one request for each chunk."""
    of = documents.select("doc_id", doc_context(F.col("meta")).alias("context"))
    prompt = F.concat(F.lit("Extract facts from pages "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(".\n\n"), "text")
    return chunks.join(of, "doc_id").select("chunk_id", "doc_id", "context", prompt.alias("prompt"))


def doc_label(title: Column, filename: Column, doc_type: Column, published: Column) -> Column:
    bits = F.array(F.coalesce(F.nullif(title, F.lit("")), filename), blank_if_null(doc_type), F.concat(F.lit("published "), or_else(published, "?")))
    return F.array_join(F.filter(bits, lambda b: b != ""), " · ")


def fact_line(tag: Column) -> Column:
    """A fact as the judge sees it."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    scale = F.when(c("scale") == "none", "").otherwise(c("scale"))
    value = F.when(F.col("kind") == "numeric", F.trim(F.concat(c("value_text"), F.lit(" "), c("unit"), F.lit(" "), scale))).otherwise(c("value_text"))
    period = F.concat(or_else(c("period_label"), "-"), F.when(c("period_start") != "", F.concat(F.lit(" ("), c("period_start"), F.lit(".."), c("period_end"), F.lit(")"))).otherwise(""))
    return F.concat(
        F.lit("- id="), c("id"), F.lit(" | doc="), tag, F.lit(" | page "), c("page_no"), F.lit("\n  subject: "), c("subject"), F.lit(" | attribute: "), c("attribute"),
        F.lit(" | value: "), value, F.lit(" | period: "), period, F.lit(" | basis: "), or_else(c("basis"), "-"), F.lit(" | scope: "), or_else(c("scope"), "-"),
        F.lit('\n  quote: "'), F.left(c("quote"), F.lit(300)), F.lit('"'),
    )


def legend_entry(tag: Column, meta: Column, filename: Column) -> Column:
    """What a judgement request says about a document: its label, the period it covers, its convention and notes where there are any."""
    period = F.concat(or_else(meta["period_covered_start"], "?"), F.lit(".."), or_else(meta["period_covered_end"], "?"))
    more = lambda heading, key: F.when(blank_if_null(meta[key]) != "", F.concat(F.lit(f"\n    {heading}: "), meta[key])).otherwise("")
    return F.concat(
        tag, F.lit(": "), doc_label(meta["title"], filename, meta["doc_type"], meta["publication_date"]), F.lit("\n    period covered: "), period,
        more("year convention", "fiscal_year_convention"), more("vintage notes", "data_vintage_notes"),
    )


def judgement_requests(members: DataFrame, facts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, members): a text (doc_id, batch, prompt) for each batch, and its facts with their group and document tag.

    members: doc_id, batch, nth, place, fact_id (batch_members); documents: doc_id, filename, meta. A text tells documents apart by
    tags, D1 onwards in order of their ids. Only what belongs to one batch, some forty facts, is put together in one place.
    """
    of = facts.select(F.col("id").alias("fact_id"), F.col("doc_id").alias("fact_doc"))
    met = members.join(of, "fact_id")
    docs = met.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_set("fact_doc")).alias("docs"))
    tags = docs.select("doc_id", "batch", F.posexplode("docs").alias("n", "fact_doc")).withColumn("tag", F.concat(F.lit("D"), F.col("n") + 1))
    tagged = met.join(tags, ["doc_id", "batch", "fact_doc"]).select("doc_id", "batch", "nth", "place", "fact_id", "fact_doc", "tag")

    shown = facts.drop("doc_id", "fact_id", "nth", "place", "batch", "tag")
    lines = tagged.join(shown, F.col("id") == F.col("fact_id")).withColumn("line", fact_line(F.col("tag")))
    group = F.concat(F.lit("### Group "), F.col("nth") + 1, F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "fact_id", "line"))), lambda x: x["line"]), "\n"))
    groups = lines.groupBy("doc_id", "batch", "nth").agg(group.alias("text"))
    body = groups.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    entries = tags.join(documents.select(F.col("doc_id").alias("fact_doc"), "filename", "meta"), "fact_doc").withColumn("entry", legend_entry(F.col("tag"), F.col("meta"), F.col("filename")))
    legend = entries.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n").alias("legend"))
    prompt = F.concat(F.lit("Documents:\n"), "legend", F.lit("\n\nFact groups (compare facts within a group, across documents only):\n\n"), "body")
    return body.join(legend, ["doc_id", "batch"]).select("doc_id", "batch", prompt.alias("prompt")), tagged
