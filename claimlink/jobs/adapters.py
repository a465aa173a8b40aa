"""The driver's tables in this library's schemas. SQL texts run as they are on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_A_PAGE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """sql over the named tables, which it mentions as {name}."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of five lines."""
    lines = F.col("lines")  # a column, as an expression would be computed anew for each page
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lines) / LINES_A_PAGE).cast("int") - 1), lambda i: F.array_join(F.slice(lines, i * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n", -1).alias("lines")).select("doc_id", F.posexplode(parts).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("page_no"), "text")


PAGES_SQL = """
pages AS (
  SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_no, array_to_string(lines[i * 5 + 1 : i * 5 + 5], chr(10)) AS text
  FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(range(0, CAST(ceil(len(lines) / 5.0) AS BIGINT))) AS i) r
)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes cut from odd pages: as they are, with doubled spaces, in upper case, or with an e struck out; the cited page is up to one off."""
    base = pages(spark, sf_dir).where((F.col("page_no") % 2 == 1) & (F.length("text") >= 100)).withColumn("n", F.col("doc_id").cast("long")).withColumn("q", F.trim(F.substring("text", 11, 80)))
    variant = F.when(F.col("n") % 4 == 0, F.col("q")).when(F.col("n") % 4 == 1, F.replace("q", F.lit(" "), F.lit("  "))).when(F.col("n") % 4 == 2, F.upper("q")).otherwise(F.replace("q", F.lit("e"), F.lit("#")))
    cited = F.greatest(F.lit(1), F.col("page_no") + F.col("n") % 3 - 1).cast("int")
    return base.select(
        F.concat("doc_id", F.lit("-"), F.col("page_no").cast("string")).alias("fact_id"), "doc_id", cited.alias("page"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        F.when(F.col("n") % 5 == 0, "numeric").otherwise("statement").alias("kind"), F.when(F.col("n") % 10 == 0, F.col("n").cast("double")).alias("value_num"), variant.alias("quote"),
        ((F.col("n") % 11) / 10.0).alias("confidence"), F.array().cast("array<string>").alias("flags"),
    )


QUOTES_SQL = (
    PAGES_SQL
    + """, cut AS (
  SELECT doc_id, page_no, CAST(doc_id AS BIGINT) AS n, trim(substring(text, 11, 80), ' ') AS q FROM pages WHERE page_no % 2 = 1 AND length(text) >= 100
), quotes AS (
  SELECT doc_id || '-' || page_no AS fact_id, doc_id, CAST(greatest(1, page_no + n % 3 - 1) AS INTEGER) AS page,
    CASE n % 4 WHEN 0 THEN q WHEN 1 THEN replace(q, ' ', '  ') WHEN 2 THEN upper(q) ELSE replace(q, 'e', '#') END AS quote, n
  FROM cut
)"""
)


def verbatim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as they stand, of 1 to 60 characters, from every page that isn't blank, at places all over the page; the cited page is up to one off."""
    base = pages(spark, sf_dir).withColumn("n", F.col("doc_id").cast("long"))
    at = 1 + (F.col("n") * 7919 + F.col("page_no") * 104_729) % F.greatest(F.length("text") - 59, F.lit(1))
    base = base.withColumn("quote", F.trim(F.substring("text", at.cast("int"), F.lit(60)), F.lit(" \n"))).where("quote <> ''")
    cited = F.greatest(F.lit(1), F.col("page_no") + F.col("n") % 3 - 1).cast("int")
    return base.select(
        F.concat("doc_id", F.lit("-"), F.col("page_no").cast("string")).alias("fact_id"), "doc_id", cited.alias("page"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        F.when(F.col("n") % 2 == 0, "numeric").otherwise("statement").alias("kind"), F.when(F.col("n") % 6 != 0, (F.col("n") % 10).cast("double")).alias("value_num"), "quote",
        ((F.col("n") % 11) / 10.0).alias("confidence"), F.when(F.col("n") % 3 == 0, F.array(F.lit("low_confidence"), F.lit("kept"))).alias("flags"),
    )


VERBATIM_SQL = (
    PAGES_SQL
    + r""", cut AS (
  SELECT *, CAST(doc_id AS BIGINT) AS n, trim(substring(text, 1 + (CAST(doc_id AS BIGINT) * 7919 + page_no * 104729) % greatest(length(text) - 59, 1), 60), ' ' || chr(10)) AS quote FROM pages
), quotes AS (
  SELECT doc_id || '-' || page_no AS fact_id, doc_id, CAST(greatest(1, page_no + n % 3 - 1) AS INTEGER) AS page, n, quote, CASE WHEN n % 2 = 0 THEN 'numeric' ELSE 'statement' END AS kind,
    CASE WHEN n % 6 <> 0 THEN CAST(n % 10 AS DOUBLE) END AS value_num, (n % 11) / 10.0 AS confidence FROM cut WHERE quote <> ''
)"""
)


#: Order values of each nation and April-March year as two publishers give them: one in thousands, one in millions; for every third
#: nation the second counts finished orders only.
NUMBERS_SQL = """
SELECT nation, year, publisher, CAST(CASE publisher WHEN 'A' THEN round(total / 1e3, 1) ELSE round(total / 1e6, 2) END AS DOUBLE) AS value_num FROM (
  SELECT n.n_nationkey AS nation, CAST(year(o.o_orderdate) - CASE WHEN month(o.o_orderdate) < 4 THEN 1 ELSE 0 END AS INTEGER) AS year, p.publisher,
    sum(CASE WHEN p.publisher = 'A' OR n.n_nationkey % 3 <> 0 OR o.o_orderstatus = 'F' THEN CAST(o.o_totalprice AS DOUBLE) ELSE 0 END) AS total
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey,
    (SELECT 'A' AS publisher UNION ALL SELECT 'B') p
  GROUP BY 1, 2, 3
) t
"""


def raw_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUMBERS_SQL as extracted facts; the publishers write unit, scale and period in their own ways."""
    a = F.col("publisher") == "A"
    label = F.when(a, F.concat(F.lit("FY"), F.col("year") + 1)).otherwise(F.concat(F.lit("FY "), F.col("year"), F.lit("-"), F.col("year") + 1))
    text = lambda value: F.lit(value).cast("string")
    return run_sql(spark, sf_dir, NUMBERS_SQL, "orders", "customer", "nation").select(
        F.concat("publisher", "nation").alias("doc_id"), F.concat_ws("-", "publisher", "nation", "year").alias("chunk_id"), F.col("year").alias("ordinal"), F.lit(1).alias("page"), text("numeric").alias("kind"),
        text(None).alias("subject"), text(" Total order value ").alias("attribute"), F.format_string("%.2f", "value_num").alias("value_text"), "value_num", F.when(a, "USD").otherwise("$").alias("unit"),
        F.when(a, "thousands").otherwise("mn").alias("scale"), label.alias("period_label"), text("").alias("period_start"), text("").alias("period_end"), text("none").alias("period_type"),
        F.when(a, "").otherwise("Actual").alias("basis"), F.concat(F.lit("Nation "), "nation").alias("scope"), text("").alias("quote"), F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("flags"),
    )


def publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each publisher and nation."""
    text = lambda v, n: F.lit(v).cast("string").alias(n)
    both = F.explode(F.array(F.lit("A"), F.lit("B")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", both.alias("publisher"))
    meta = F.struct(F.concat("n_name", F.lit(" in figures")).alias("title"), F.col("publisher"), text("report", "doc_type"), text("2020-01", "publication_date"), *(text("", k) for k in ("period_covered_start", "period_covered_end")),
                    text("Fiscal year April to March", "fiscal_year_convention"), text("USD", "default_currency"), text("", "default_scale"), F.col("n_name").alias("primary_subject"), text("", "data_vintage_notes"))
    return rows.select(F.concat("publisher", "nation").alias("doc_id"), F.concat("publisher", "nation", F.lit(".pdf")).alias("filename"), F.lit(1).alias("page_count"), meta.alias("meta"))


#: Embeddings as facts of seven documents; other columns vary with the id.
FACTS_SQL = """
SELECT lpad(CAST(vec_id AS VARCHAR(20)), 8, '0') AS id, 'd' || CAST(vec_id % 7 AS VARCHAR(9)) AS doc_id, CAST(vec_id % 7 AS INTEGER) AS doc_seq, CAST(vec_id % 13 + 1 AS INTEGER) AS page_no,
  CASE WHEN label % 2 = 0 THEN 'numeric' ELSE 'statement' END AS kind, 'Subject ' || CAST(vec_id % 5 AS VARCHAR(9)) AS subject, 'Key_' || CAST(label AS VARCHAR(9)) AS attribute, 'k' || CAST(label AS VARCHAR(9)) AS attribute_key,
  CAST(vec_id % 40 AS VARCHAR(9)) AS value_text, CAST(vec_id % 40 AS DOUBLE) AS value_norm, CASE vec_id % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' ELSE '%' END AS unit, CASE vec_id % 4 WHEN 0 THEN 'crore' ELSE 'none' END AS scale,
  CASE vec_id % 6 WHEN 0 THEN '' ELSE 'FY' || CAST(2000 + vec_id % 10 AS VARCHAR(9)) END AS period_label,
  CASE vec_id % 6 WHEN 0 THEN '' ELSE CAST(1999 + vec_id % 10 AS VARCHAR(9)) || '-04-01' END AS period_start, CASE vec_id % 6 WHEN 0 THEN '' ELSE CAST(2000 + vec_id % 10 AS VARCHAR(9)) || '-03-31' END AS period_end,
  CASE vec_id % 8 WHEN 0 THEN 'Provisional' ELSE '' END AS basis, CASE vec_id % 9 WHEN 0 THEN 'Group' ELSE '' END AS scope, 'Quote 100% of ' || CAST(vec_id % 17 AS VARCHAR(9)) AS quote,
  CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(vec_id % 97 AS INTEGER) END AS quote_start,
  CASE WHEN vec_id % 10 < 6 THEN 'exact' WHEN vec_id % 10 = 6 THEN 'fuzzy' WHEN vec_id % 10 = 7 THEN 'window' ELSE 'unverified' END AS grounding, CAST((vec_id % 100) / 100.0 AS DOUBLE) AS confidence, vec_id, label
FROM {embeddings}
"""
#: (flag, condition on vec_id) in order; facts have them as an array.
FLAGS = (("page_corrected:1->2", "vec_id % 12 = 0"), ("value_not_in_quote", "vec_id % 7 = 0"), ("low_confidence", "vec_id % 100 < 30"))
#: Relations between facts near each other, some of which lack a side.
RELATIONS_SQL = """
SELECT lpad(CAST(a AS VARCHAR(20)), 8, '0') AS fact_a, lpad(CAST(b AS VARCHAR(20)), 8, '0') AS fact_b, CASE (a + b) % 4 WHEN 0 THEN 'corroborates' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'reconciled' ELSE 'unrelated' END AS type,
  CASE WHEN (a + b) % 4 = 2 THEN CASE (a + b) % 5 WHEN 0 THEN 'period' WHEN 1 THEN 'scope' WHEN 2 THEN 'unit' WHEN 3 THEN 'vintage' ELSE 'other' END END AS reconciliation,
  CAST(((a * 7 + b) % 100) / 100.0 AS DOUBLE) AS confidence, 'Because of ' || CAST(a % 19 AS VARCHAR(9)) AS reasoning, CASE (a + b) % 3 WHEN 0 THEN 'deterministic' ELSE 'llm' END AS method, a % 7 <> b % 7 AS cross_document, a AS created_at
FROM (SELECT vec_id AS a, vec_id + k AS b FROM {embeddings}, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 7) s WHERE (vec_id + k) % 3 <> 1) p
"""
DOCUMENTS_SQL = """
SELECT 'd' || CAST(vec_id % 7 AS VARCHAR(9)) AS doc_id, 'file' || CAST(vec_id % 7 AS VARCHAR(9)) || '.pdf' AS filename, 'Title ' || CAST(vec_id % 7 AS VARCHAR(9)) AS title, '2024-0' || CAST(vec_id % 7 + 1 AS VARCHAR(9)) AS publication_date,
  CASE WHEN vec_id % 7 = 6 THEN 'failed' ELSE 'done' END AS status, CAST(vec_id % 7 AS INTEGER) AS created_at
FROM {embeddings} GROUP BY vec_id % 7
"""
#: Events as a log of calls.
CALLS_SQL = """
SELECT event_type AS purpose, CAST(user_id % 3 AS VARCHAR(9)) AS model, event_type <> 'error' AS ok, CAST(round(value * 1000) AS BIGINT) AS duration_ms, CAST(round(value / 100, 4) AS DOUBLE) AS cost_usd, event_id AS created_at FROM {events}
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(*(F.when(F.expr(c), f) for f, c in FLAGS)))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return run_sql(spark, sf_dir, FACTS_SQL, "embeddings").withColumn("flags", flags).join(vectors, "vec_id").withColumn("fact_id", F.col("id"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, RELATIONS_SQL, "embeddings")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, DOCUMENTS_SQL, "embeddings")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, CALLS_SQL, "events")


def _plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


_FLAG_LIST = ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in FLAGS)
#: The same tables as DuckDB's common table expressions.
LAYER_SQL = (
    f"facts AS (SELECT *, list_filter([{_FLAG_LIST}], lambda x: x IS NOT NULL) AS flags FROM ({_plain(FACTS_SQL)}) f), relations AS ({_plain(RELATIONS_SQL)}), docs AS ({_plain(DOCUMENTS_SQL)}),"
    " ends AS (SELECT fact_a AS fact_id, fact_b AS other_id, * FROM relations UNION ALL SELECT fact_b, fact_a, * FROM relations)"
)
