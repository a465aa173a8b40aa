"""Grounding: does a fact's quote stand on the page that it cites, or on a page near by, and at which tier?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlink.functions.helpers import approximate, number_in_quote
from claimlink.functions.text import blank_if_null, locate, strip

#: The flags that verification sets, by how they begin.
VERIFICATION = ("page_corrected", "quote_", "value_not", "numeric_without", "low_conf", "empty_quote")
FUZZY_SURE = 97.0


def candidate_pages(facts: DataFrame) -> DataFrame:
    """(fact_id, doc_id, quote, place, page_no): the cited page, the others of its chunk, then the neighbours of the cited one."""
    cited, first, last = F.coalesce("page", F.lit(0)), F.coalesce("page_start", "page", F.lit(0)), F.coalesce("page_end", "page", F.lit(0))
    chunk = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    pages = F.array_distinct(F.concat(F.array(cited), chunk, F.array(cited - 1, cited + 1)))
    return facts.select("fact_id", "doc_id", strip(blank_if_null(F.col("quote"))).alias("quote"), F.posexplode(pages).alias("place", "page_no")).where("page_no >= 1")


def pick_best(found: DataFrame) -> DataFrame:
    """One row for each fact of (fact_id, place, page_no, tier, score, start, end).

    Exact hits and all but certain fuzzy ones come first, by their place; then fuzzy ones, then windows, by score and place.
    """
    sure = (F.col("tier") == "exact") | ((F.col("tier") == "fuzzy") & (F.col("score") >= FUZZY_SURE))
    rank = F.when(sure, 0).when(F.col("tier") == "fuzzy", 1).otherwise(2)
    key = F.struct(rank.alias("r"), F.when(sure, F.lit(0.0)).otherwise(-F.col("score")).alias("s"), "place")
    return found.groupBy("fact_id").agg(F.min_by(F.struct("page_no", "tier", "score", "start", "end"), key).alias("best"))


def verification_flags(cited: Column, best: Column, use_numbers: Column) -> Column:
    """The flags of a fact in their order: those it had but for verification's own, then the quote's, the value's and the confidence's."""
    other = F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: ~F.exists(F.array(*map(F.lit, VERIFICATION)), lambda v: F.startswith(f, v)))
    quote = strip(blank_if_null(F.col("quote")))
    flag = lambda when, text: F.when(when, text if isinstance(text, Column) else F.lit(text))
    own = [
        flag(quote == "", "empty_quote"),
        flag(best.isNull(), "quote_not_found"),
        flag(best["page_no"] != cited, F.concat(F.lit("page_corrected:"), cited.cast("string"), F.lit("->"), best["page_no"].cast("string"))),
        flag(best["tier"] == "window", "quote_not_contiguous"),
        F.when(F.col("kind") == "numeric", F.when(F.col("value_num").isNull(), "numeric_without_value").when((quote != "") & ~use_numbers, "value_not_in_quote")),
        flag(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)) < 0.7, "low_confidence"),
    ]
    return F.concat(other, F.array_compact(F.array(*own)))


def ground(facts: DataFrame, pages: DataFrame, tiers: str = "all") -> DataFrame:
    """facts with page, grounding, grounding_score, quote_start, quote_end and flags set from the pages' texts.

    facts: fact_id, doc_id, page, page_start, page_end, kind, value_num, quote, confidence, flags and any others. Page texts only
    meet quotes, in joins by document and page; what is shuffled by fact are offsets and scores. The costly tiers run on the
    candidate pages before a fact's first exact hit alone. tiers: all, or exact for the cheap ones only.
    """
    asked = candidate_pages(facts)
    text = pages.select("doc_id", "page_no", "text").where(F.length("text") > 0)
    hit = F.inline_outer(F.array(locate(F.col("text"), F.col("quote"))))  # as a column it would be computed again for the filter
    exact = asked.where("quote <> ''").join(text, ["doc_id", "page_no"]).select("fact_id", "place", "page_no", F.lit("exact").alias("tier"), hit).where("score IS NOT NULL")
    found = exact
    if tiers == "all":
        first = exact.groupBy("fact_id").agg(F.min("place").alias("first"))
        rest = asked.where("quote <> ''").join(first, "fact_id", "left").where("first IS NULL OR place < first").join(text, ["doc_id", "page_no"])
        rest = rest.select("fact_id", "place", "page_no", approximate("quote", "text").alias("a"))
        both = F.array(*(F.struct(F.lit(n).alias("tier"), F.col(f"a.{n}").alias("x")) for n in ("fuzzy", "window")))
        rest = rest.select("fact_id", "place", "page_no", F.explode(both).alias("t")).where("t.x IS NOT NULL").select("fact_id", "place", "page_no", "t.tier", "t.x.*")
        found = exact.unionByName(rest)
    out = facts.join(pick_best(found), "fact_id", "left")
    best, cited = F.col("best"), F.coalesce("page", F.lit(0))
    new = {
        "flags": verification_flags(cited, best, number_in_quote("value_num", "quote")),
        "page": F.coalesce(best["page_no"], F.col("page")),
        "grounding": F.coalesce(best["tier"], F.lit("unverified")),
        "grounding_score": F.coalesce(best["score"], F.lit(0.0)),
        "quote_start": best["start"],
        "quote_end": best["end"],
    }
    return out.withColumns(new).drop("best")


def pages_of_chunk(chunk_id: Column, page: Column) -> tuple[Column, Column]:
    """First and last page that a chunk's id names; the page itself where it names none."""
    number = lambda g: F.nullif(F.regexp_extract(chunk_id, r":(\d+)-(\d+)", g), F.lit("")).cast("int")
    return F.coalesce(number(1), page), F.coalesce(number(2), page)


def reground(facts: DataFrame, pages: DataFrame, tiers: str = "all") -> DataFrame:
    """Stored facts (page_no, chunk_id) grounded again. They cite the page that an earlier run may have corrected."""
    first, last = pages_of_chunk(F.col("chunk_id"), F.col("page_no"))
    again = facts.withColumn("page", F.col("page_no")).withColumn("page_start", first).withColumn("page_end", last)
    return ground(again, pages, tiers).withColumn("page_no", F.col("page")).drop("page", "page_start", "page_end")


def evidence_view(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts with before, marked and after: the page's text about the quote; its first occurrence where there are no offsets."""
    text = pages.select("doc_id", "page_no", F.col("text").alias("page_text"))
    joined = facts.join(text, ["doc_id", "page_no"], "left").withColumn("page_text", blank_if_null(F.col("page_text")))
    quote = blank_if_null(F.col("quote"))
    at = F.instr("page_text", quote) - 1
    start = F.coalesce("quote_start", F.when((quote != "") & (at >= 0), at))
    end = F.when(F.col("quote_start").isNotNull(), F.col("quote_end")).when((quote != "") & (at >= 0), at + F.length(quote))
    joined = joined.withColumn("_s", start).withColumn("_e", end)
    parts = {
        "before": F.when(F.col("_s").isNull(), F.col("page_text")).otherwise(F.substring(F.col("page_text"), F.lit(1), F.col("_s"))),
        "marked": F.when(F.col("_s").isNull(), "").otherwise(F.substring(F.col("page_text"), F.col("_s") + 1, F.col("_e") - F.col("_s"))),
        "after": F.when(F.col("_s").isNull(), "").otherwise(F.substring(F.col("page_text"), F.col("_e") + 1, F.length("page_text"))),
    }
    return joined.withColumns(parts).drop("_s", "_e", "page_text")
