"""Search, counts, showcases and timelines over facts (id, doc_id, ...), relations (fact_a, fact_b, ...) and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlink.functions.text import contains_like
from claimlink.sources.schemas import RECONCILIATIONS


def endpoints(relations: DataFrame) -> DataFrame:
    """Each relation once for each of its facts, as fact_id and other_id."""
    ends = F.array(F.struct(F.col("fact_a").alias("fact_id"), F.col("fact_b").alias("other_id")), F.struct(F.col("fact_b").alias("fact_id"), F.col("fact_a").alias("other_id")))
    return relations.withColumn("e", F.explode(ends)).select("*", "e.*").drop("e")


def related(relations: DataFrame) -> DataFrame:
    return relations.where("type <> 'unrelated'")


def relation_counts(relations: DataFrame) -> DataFrame:
    """(fact_id, rel_count): relations of each fact, unrelated pairs aside."""
    return endpoints(related(relations)).groupBy("fact_id").agg(F.count("*").alias("rel_count"))


def with_doc_columns(facts: DataFrame, documents: DataFrame, relations: DataFrame) -> DataFrame:
    """facts with their document's filename, title and date and with their number of relations."""
    docs = documents.select("doc_id", F.col("filename").alias("doc_filename"), F.col("title").alias("doc_title"), F.col("publication_date").alias("doc_date"))
    counts = relation_counts(relations).withColumnRenamed("fact_id", "id")
    return facts.join(docs, "doc_id").join(counts, "id", "left").fillna(0, ["rel_count"])


def search_facts(facts: DataFrame, q: str | None = None, flagged: bool | None = None, **equal: str) -> DataFrame:
    """Facts with the given doc_id, kind, grounding or attribute_key, with or without flags, in which q is found."""
    for column, value in equal.items():
        facts = facts.where(F.col(column) == value)
    if flagged is not None:
        facts = facts.where((F.size("flags") > 0) == flagged)
    return facts.where(contains_like([F.col(c) for c in ("subject", "attribute", "value_text", "quote", "period_label")], q)) if q else facts


def page_of_facts(facts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in the order of documents and pages; facts that aren't located come first on their page."""
    return facts.orderBy("doc_id", "page_no", F.asc_nulls_first("quote_start"), "id").offset(offset).limit(min(limit, 1000))


def facts_in_order(facts: DataFrame) -> DataFrame:
    """The order in which a document's facts are stored: by page, those that aren't located last."""
    return facts.orderBy("doc_id", "page_no", F.asc_nulls_last("quote_start"), "id")


def attach_facts(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """relations with their facts as structs a and b; those that lack one are left out."""
    side = lambda p: facts.select(F.col("id").alias(f"fact_{p}"), F.struct(*facts.columns).alias(p))
    return relations.join(side("a"), "fact_a").join(side("b"), "fact_b")


def search_relations(attached: DataFrame, type_: str | None = None, reconciliation: str | None = None, method: str | None = None, doc_id: str | None = None, q: str | None = None) -> DataFrame:
    out = attached.where(F.col("type") == type_) if type_ else related(attached)
    if reconciliation:
        out = out.where(F.col("reconciliation") == reconciliation)
    if method:
        out = out.where(F.col("method") == method)
    if doc_id:
        out = out.where((F.col("a.doc_id") == doc_id) | (F.col("b.doc_id") == doc_id))
    return out.where(contains_like([F.col("a.subject"), F.col("a.attribute"), F.col("b.attribute"), F.col("reasoning")], q)) if q else out


def page_of_relations(relations: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return relations.orderBy(F.desc("confidence"), "created_at", "fact_a", "fact_b").offset(offset).limit(min(limit, 2000))


def relations_for(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations that touch one of the ids (id), each once."""
    found = endpoints(relations).join(ids.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    return found.select(*relations.columns).dropDuplicates(["fact_a", "fact_b"])


def document_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("grounding") == "unverified").alias("unverified"))


def relations_per_document(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """A relation between two documents counts once for each."""
    of = facts.select(F.col("id").alias("fact_id"), "doc_id")
    sides = endpoints(related(relations)).join(of, "fact_id").select("fact_a", "fact_b", "doc_id").distinct()
    return sides.groupBy("doc_id").agg(F.count("*").alias("relations"))


def document_overview(documents: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    out = documents.join(document_counts(facts), "doc_id", "left").join(relations_per_document(relations, facts), "doc_id", "left")
    return out.fillna(0, ["facts", "unverified", "relations"])


def fact_totals(facts: DataFrame) -> DataFrame:
    """Totals by kind and tier, and the grounded share in percent (0 without facts)."""
    is_ = lambda column, value: F.count_if(F.col(column) == value).alias(value)
    totals = [F.count("*").alias("n"), *(is_("kind", k) for k in ("numeric", "statement")), *(is_("grounding", g) for g in ("exact", "fuzzy", "window", "unverified")), F.count_if(F.size("flags") > 0).alias("flagged")]
    share = F.when(F.col("n") > 0, F.round(100 * (F.col("n") - F.col("unverified")) / F.col("n"))).otherwise(0.0)
    return facts.agg(*totals).withColumn("grounded_percent", share.cast("long"))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def reconciliation_kinds(relations: DataFrame) -> DataFrame:
    return counts_by(relations.where("type = 'reconciled'"), "reconciliation").orderBy(F.desc("n"), "reconciliation")


def flag_families(facts: DataFrame) -> DataFrame:
    """Flags counted by the part before a colon."""
    return counts_by(facts.select(F.explode("flags").alias("f")).select(F.substring_index("f", ":", 1).alias("flag")), "flag")


def call_totals(calls: DataFrame) -> DataFrame:
    tokens = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens") if c in calls.columns]
    return calls.groupBy("purpose", "model").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.round(F.sum("cost_usd"), 3).alias("usd"), F.round(F.avg("duration_ms") / 1000, 1).alias("avg_s"), *tokens)


def _shown(attached: DataFrame) -> DataFrame:
    return attached.where("cross_document AND a.grounding <> 'unverified' AND b.grounding <> 'unverified'")


def showcase_corroborated(attached: DataFrame, n: int = 12) -> DataFrame:
    """Corroborations that a judge found, those that are put differently first."""
    differ = lambda *names: F.greatest(*(F.coalesce((F.col(f"a.{c}") != F.col(f"b.{c}")).cast("int"), F.lit(-1)) for c in names))
    rows = _shown(attached).where("type = 'corroborates' AND method = 'llm'")
    return rows.orderBy(F.desc(differ("scale", "unit")), F.desc(differ("value_text", "attribute")), F.desc(F.col("a.kind") == "statement"), F.desc("confidence"), "fact_a", "fact_b").limit(n)


def showcase_contradictions(attached: DataFrame, n: int = 12) -> DataFrame:
    return _shown(attached).where("type = 'contradicts'").orderBy(F.desc("confidence"), "fact_a", "fact_b").limit(n)


def showcase_reconciled(attached: DataFrame, each: int = 2, n: int = 15) -> DataFrame:
    """The best of each kind of reconciliation, in a fixed order of kinds."""
    place = F.array_position(F.array(*map(F.lit, RECONCILIATIONS)), F.col("reconciliation"))
    best = Window.partitionBy("reconciliation").orderBy(F.desc("confidence"), "fact_a", "fact_b")
    rows = _shown(attached).where("type = 'reconciled'").withColumn("place", place).where("place > 0").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= each)
    return rows.orderBy("place", "nth").limit(n)


def failure_report(facts: DataFrame, n: int = 15) -> DataFrame:
    """(case, nth, id): some facts of each kind of failure, in a defined order."""
    has = lambda flag: F.exists("flags", lambda f: F.startswith(f, F.lit(flag)))
    cases: dict[str, tuple[Column, list]] = {
        "quote_not_found": (F.col("grounding") == "unverified", [F.desc("confidence"), "id"]),
        "value_not_in_quote": (has("value_not_in_quote"), ["id"]),
        "page_corrected": (has("page_corrected"), ["id"]),
        "low_confidence": (has("low_confidence"), ["confidence", "id"]),
    }
    out = None
    for case, (which, order) in cases.items():
        top = facts.where(which).orderBy(*order).limit(n)  # few rows, numbered in one task
        top = top.select(F.lit(case).alias("case"), F.row_number().over(Window.orderBy(*order)).alias("nth"), "id")
        out = top if out is None else out.unionByName(top)
    return out


def failed_calls(calls: DataFrame, n: int = 15) -> DataFrame:
    return calls.where("NOT ok").orderBy(F.desc("created_at"), "purpose", "model", "duration_ms").limit(n)


def unrelated_matches(relations: DataFrame, n: int = 10) -> DataFrame:
    return relations.where("type = 'unrelated'").orderBy(F.desc("confidence"), "fact_a", "fact_b").limit(n)


def timelines(anchors: DataFrame, facts: DataFrame, relations: DataFrame, documents: DataFrame, most: int = 200) -> DataFrame:
    """(anchor, nth, id, type, is_anchor): for each anchor (id) the facts of its key and kind, the first most by period, and those
    that a relation links to it, in the order of their periods. All anchors of a key share one ranked list."""
    facts = facts.join(documents.select("doc_id", "created_at", F.col("publication_date").alias("doc_date")), "doc_id")
    shown = facts.select("id", "attribute_key", "kind", "period_start", "period_end", "doc_date", "created_at")
    asked = shown.join(anchors.select("id"), "id", "left_semi").select(F.col("id").alias("anchor"), "attribute_key", "kind")
    first = Window.partitionBy("attribute_key", "kind").orderBy(F.asc_nulls_first("period_start"), F.asc_nulls_first("created_at"), "id")
    siblings = shown.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).drop("r")
    by_key = asked.join(siblings, ["attribute_key", "kind"]).select("anchor", "id")
    links = endpoints(related(relations)).select(F.col("fact_id").alias("anchor"), F.col("other_id").alias("id"), "type")
    links = links.join(asked.select("anchor"), "anchor", "left_semi").dropDuplicates(["anchor", "id"])
    members = by_key.unionByName(links.select("anchor", "id")).dropDuplicates()
    rows = members.join(shown.drop("attribute_key", "kind", "created_at"), "id").join(links, ["anchor", "id"], "left")
    order = Window.partitionBy("anchor").orderBy(F.coalesce(F.nullif("period_start", F.lit("")), F.lit("9999")), F.coalesce("period_end", F.lit("")), F.coalesce("doc_date", F.lit("")), "id")
    return rows.select("anchor", F.row_number().over(order).alias("nth"), "id", "type", (F.col("id") == F.col("anchor")).alias("is_anchor"))
