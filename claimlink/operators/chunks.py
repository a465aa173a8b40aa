"""Packing page texts into chunks and chunks into requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlink.functions.text import blank_if_null

_RUN = "struct<first:int,last:int,size:long,whole:boolean>"


def greedy_runs(items: Column, limit: int) -> Column:
    """array of struct(first, last, size, whole) from an ordered array of struct(no, size): consecutive items up to a total of limit.

    The total starts anew at each cut. An item above the limit is a run of its own, marked as not whole; empty ones are passed over.
    """

    def step(runs: Column, item: Column) -> Column:
        open_ = F.try_element_at(runs, F.lit(-1))
        size = item["size"].cast("long")
        alone = F.array(F.struct(item["no"].alias("first"), item["no"].alias("last"), size.alias("size"), (size <= limit).alias("whole")))
        grown = F.array(F.struct(open_["first"].alias("first"), item["no"].alias("last"), (open_["size"] + size).alias("size"), F.lit(True).alias("whole")))
        fits = open_.isNotNull() & open_["whole"] & (size <= limit) & (open_["size"] + size <= limit)
        return F.when(size == 0, runs).when(fits, F.concat(F.slice(runs, 1, F.size(runs) - 1), grown)).otherwise(F.concat(runs, alone))

    return F.aggregate(items, F.array().cast(f"array<{_RUN}>"), step)


def split_text(text: Column, limit: int) -> Column:
    """Parts of a text of at most limit characters: paragraphs together while they fit, cut hard where one is longer."""

    def step(parts: Column, paragraph: Column) -> Column:
        last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
        fresh = (last != "") & (F.length(last) + F.length(paragraph) + 2 > limit)
        joined = F.when(fresh | (last == ""), paragraph).otherwise(F.concat(last, F.lit("\n\n"), paragraph))
        before = F.when(fresh | (F.size(parts) == 0), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
        pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(joined) - 1, F.lit(0)) / limit).cast("int")), lambda i: F.substring(joined, i * limit + 1, F.lit(limit)))
        return F.concat(before, pieces)

    parts = F.aggregate(F.split(text, "\n\n", -1), F.array().cast("array<string>"), step)
    return F.filter(parts, lambda p: p != "")


def make_chunks(pages: DataFrame, limit: int = 18_000) -> DataFrame:
    """(chunk_id, doc_id, page_start, page_end, text) of the pages (doc_id, page_no, text) of each document.

    Only page lengths are gathered by document; the texts meet their runs in a join. A page above the limit is split by itself.
    """
    text = pages.select("doc_id", "page_no", blank_if_null(F.col("text")).alias("text"))
    lengths = text.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("no"), F.length("text").alias("size")))).alias("items"))
    runs = lengths.select("doc_id", F.explode(greedy_runs(F.col("items"), limit)).alias("r")).select("doc_id", "r.*")
    of_page = runs.select("doc_id", F.col("first").alias("page_start"), F.col("last").alias("page_end"), "whole", F.explode(F.sequence("first", "last")).alias("page_no"))
    parts = text.where("text <> ''").join(of_page, ["doc_id", "page_no"])
    marker = F.concat(F.lit("[[page "), F.col("page_no").cast("string"), F.lit("]]\n"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    whole = parts.where("whole").groupBy("doc_id", "page_start", "page_end").agg(F.array_sort(F.collect_list(F.struct("page_no", F.concat(marker, "text").alias("t")))).alias("p"))
    whole = whole.select(name.alias("chunk_id"), "doc_id", "page_start", "page_end", F.array_join("p.t", "\n\n").alias("text"))
    long = parts.where("NOT whole").select("doc_id", "page_no", "page_start", "page_end", F.posexplode(split_text(F.col("text"), limit)).alias("j", "part"))
    long = long.select(F.concat(name, F.lit("#"), F.col("j").cast("string")).alias("chunk_id"), "doc_id", "page_start", "page_end", F.concat(marker, "part").alias("text"))
    return whole.unionByName(long)


def scanned_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, scanned): whether there is too little text for the number of pages."""
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return out.withColumn("scanned", F.col("chars") < F.floor(200 * F.greatest(F.lit(1), "pages") / 4))


def pack_groups(groups: DataFrame, limit: int = 40) -> DataFrame:
    """groups (doc_id, page_no, quote_start, fact_id, size) with batch and nth, the place in it: consecutive groups of a document up to limit facts; none is split."""
    key = F.struct(F.col("page_no"), F.col("quote_start"), F.col("fact_id"), F.greatest("size", F.lit(1)).alias("size"))
    lists = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("g"))
    items = F.transform("g", lambda x, i: F.struct(i.alias("no"), x["size"].alias("size")))
    runs = lists.select("doc_id", "g", F.posexplode(greedy_runs(items, limit)).alias("batch", "r"))
    members = F.slice("g", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + 1)
    return runs.select("doc_id", "batch", F.posexplode(members).alias("nth", "x")).select("doc_id", "batch", "nth", "x.fact_id", "x.size")
