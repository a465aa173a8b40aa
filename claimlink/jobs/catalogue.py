"""The registered queries on the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlink.functions import normalize as norm
from claimlink.functions.helpers import number_in_quote
from claimlink.functions.text import clean_text
from claimlink.jobs import adapters as t
from claimlink.operators import chunks, facts, ground, link, passages, report, requests
from claimlink.sources import schemas, tables
from claimlink.streaming import ingest, linking

Query = Callable[[SparkSession, str], DataFrame]
#: Spark 4.1 takes a union of equally partitioned inputs as partitioned, though adaptive execution may have merged partitions of one
#: of them only; counts then come out wrong (a distinct below a union kept repeats here), or the union can't be run.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"
_FOUND: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set(UNION_PARTITIONING, "false")
            return f(spark, sf_dir)

        _FOUND[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Pages, chunks and requests.


@query("WITH " + t.PAGES_SQL + r"""
SELECT doc_id, page_no, trim(regexp_replace(regexp_replace(replace(replace(text, chr(13), chr(10)), chr(12), chr(10)), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages""")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pages(spark, sf_dir).withColumn("text", clean_text(F.col("text")))


@query("WITH " + t.PAGES_SQL + " SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) < (200 * greatest(1, count(*))) // 4 AS scanned FROM pages GROUP BY doc_id")
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.scanned_documents(t.pages(spark, sf_dir))


_CHUNKS_SQL = "WITH RECURSIVE " + t.PAGES_SQL + """, p AS (
  SELECT doc_id, page_no, text, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM pages WHERE text <> '' AND length(text) <= 6000
), w AS (
  SELECT doc_id, page_no, k, n, CAST(n AS BIGINT) AS size, page_no AS page_start FROM p WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.page_no, p.k, p.n, CASE WHEN w.size + p.n > 6000 OR p.page_no - w.page_no > 1 THEN p.n ELSE w.size + p.n END, CASE WHEN w.size + p.n > 6000 OR p.page_no - w.page_no > 1 THEN p.page_no ELSE w.page_start END
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k + 1
), c AS (SELECT doc_id, page_start, max(page_no) AS page_end FROM w GROUP BY 1, 2)
SELECT doc_id || ':' || page_start || '-' || page_end AS chunk_id, doc_id, page_start, page_end, CAST((SELECT sum(length(text) + length('[[page ' || page_no || ']]') + 1) + 2 * (count(*) - 1) FROM pages q WHERE q.doc_id = c.doc_id AND q.page_no BETWEEN page_start AND page_end) AS BIGINT) AS chars
FROM c"""


@query(_CHUNKS_SQL)
def whole_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole pages, with their texts' lengths; pages that are split by themselves are all_chunks' part."""
    made = chunks.make_chunks(t.pages(spark, sf_dir), 6000).where(~F.contains("chunk_id", F.lit("#")))
    return made.select("chunk_id", "doc_id", "page_start", "page_end", F.length("text").cast("long").alias("chars"))


_ALL_CHUNKS_SQL = _CHUNKS_SQL[: _CHUNKS_SQL.rindex("SELECT doc_id || ':'")] + """, s AS (
  SELECT doc_id, page_no, string_split(text, chr(10) || chr(10)) AS ps, CAST(0 AS BIGINT) AS i, []::VARCHAR[] AS parts FROM pages WHERE length(text) > 6000
  UNION ALL
  SELECT doc_id, page_no, ps, i + 1, list_concat(CASE WHEN fresh THEN parts ELSE parts[:-2] END, list_transform(range(0, greatest(length(joined) - 1, 0) // 6000 + 1), lambda k: substring(joined, k * 6000 + 1, 6000)))
  FROM (SELECT *, CASE WHEN fresh OR last = '' THEN p ELSE last || chr(10) || chr(10) || p END AS joined FROM (SELECT *, last <> '' AND length(last) + length(p) + 2 > 6000 AS fresh FROM (SELECT *, coalesce(parts[-1], '') AS last, ps[i + 1] AS p FROM s WHERE i < len(ps)) x) y) z
), part AS (
  SELECT doc_id, page_no, unnest(range(0, len(found))) AS j, unnest(found) AS text FROM (SELECT doc_id, page_no, list_filter(parts, lambda x: x <> '') AS found FROM s WHERE i = len(ps)) f
), chunk AS (
  SELECT c.doc_id || ':' || page_start || '-' || page_end AS chunk_id, c.doc_id, page_start, page_end, string_agg('[[page ' || page_no || ']]' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS text
  FROM c JOIN pages q ON q.doc_id = c.doc_id AND q.page_no BETWEEN page_start AND page_end GROUP BY c.doc_id, page_start, page_end
  UNION ALL
  SELECT doc_id || ':' || page_no || '-' || page_no || '#' || j, doc_id, page_no, page_no, '[[page ' || page_no || ']]' || chr(10) || text FROM part
)
"""


@query(_ALL_CHUNKS_SQL + "SELECT * FROM chunk")
def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.make_chunks(t.pages(spark, sf_dir), 6000)


def _page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.lit("Title" if k == "title" else "").alias(k) for k in requests.CONTEXT_KEYS]
    return t.pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("page_count")).select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), "page_count", F.struct(*keys).alias("meta"))


@query("WITH " + t.PAGES_SQL + """, n AS (SELECT doc_id, max(page_no) AS n FROM pages GROUP BY 1)
SELECT n.doc_id, 'Filename: ' || n.doc_id || '.pdf' || chr(10) || 'Total pages: ' || n || chr(10) || chr(10) || '=== FIRST PAGES ===' || chr(10)
  || coalesce(string_agg('[[page ' || page_no || ']]' || chr(10) || substring(text, 1, 6000), chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE page_no <= 4 AND text <> ''), '')
  || chr(10) || chr(10) || '=== LAST PAGE ===' || chr(10) || coalesce(max('[[page ' || page_no || ']]' || chr(10) || substring(text, 1, 3000)) FILTER (WHERE page_no > 4 AND page_no = n AND text <> ''), '') AS prompt
FROM n JOIN pages p ON p.doc_id = n.doc_id GROUP BY n.doc_id, n""")
def doc_meta_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.doc_meta_requests(t.pages(spark, sf_dir), _page_documents(spark, sf_dir))


@query(_ALL_CHUNKS_SQL + "SELECT chunk_id, doc_id, '- title: Title' || " + " || ".join(f"chr(10) || '- {k}: (unknown)'" for k in requests.CONTEXT_KEYS[1:]) + """ AS context,
  'Extract facts from pages ' || page_start || '-' || page_end || '.' || chr(10) || chr(10) || text AS prompt FROM chunk""")
def extraction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.extraction_requests(all_chunks(spark, sf_dir), _page_documents(spark, sf_dir))


# Grounding.

_GROUND_SQL = "WITH " + t.QUOTES_SQL + r""", asked AS (
  SELECT fact_id, doc_id, page, quote, n, unnest([page, page - 1, page + 1]) AS page_no, unnest([0, 1, 2]) AS place FROM quotes
), hits AS (
  SELECT a.fact_id, a.place, a.page_no, CASE WHEN contains(p.text, a.quote) THEN 100.0 ELSE 99.0 END AS score FROM asked a JOIN pages p ON p.doc_id = a.doc_id AND p.page_no = a.page_no
  WHERE contains(p.text, a.quote) OR contains(lower(regexp_replace(p.text, '\s+', ' ', 'g')), lower(regexp_replace(a.quote, '\s+', ' ', 'g')))
), best AS (SELECT fact_id, arg_min(page_no, place) AS page_no, arg_min(score, place) AS score FROM hits GROUP BY 1)
"""
_ENGLISH = " JOIN documents d ON CAST(d.doc_id AS VARCHAR) = q.doc_id AND d.lang = 'en'"


def _grounded(spark: SparkSession, sf_dir: str, tiers: str) -> DataFrame:
    return ground.ground(t.quotes(spark, sf_dir), t.pages(spark, sf_dir), tiers)


@query(_GROUND_SQL + "SELECT q.fact_id, CAST(coalesce(b.page_no, q.page) AS INTEGER) AS page, CASE WHEN b.page_no IS NULL THEN 'unverified' ELSE 'exact' END AS grounding, CAST(coalesce(b.score, 0) AS DOUBLE) AS grounding_score FROM quotes q"
       + _ENGLISH + " LEFT JOIN best b ON b.fact_id = q.fact_id")
def ground_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap tiers on English documents, whose letters both engines fold alike."""
    english = t.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"))
    quotes, pages = (f(spark, sf_dir).join(english, "doc_id", "left_semi") for f in (t.quotes, t.pages))
    return ground.ground(quotes, pages, "exact").select("fact_id", "page", "grounding", "grounding_score")


@query()
def ground_exact_all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap tiers on all documents. Without SQL, as the engines fold some letters of other languages in different ways."""
    return _grounded(spark, sf_dir, "exact").select("fact_id", "page", "grounding", "grounding_score")


_GROUND_VERBATIM_SQL = _GROUND_SQL.replace(t.QUOTES_SQL, t.VERBATIM_SQL).replace("a.fact_id, a.place, a.page_no, CASE", "a.fact_id, a.place, a.page_no, position(a.quote IN p.text) - 1 AS pos, length(a.quote) AS size, CASE").replace(
    "arg_min(score, place) AS score", "arg_min(score, place) AS score, arg_min(pos, place) AS pos, arg_min(size, place) AS size")


@query(_GROUND_VERBATIM_SQL + r"""SELECT q.fact_id, CAST(coalesce(b.page_no, q.page) AS INTEGER) AS page, CASE WHEN b.page_no IS NULL THEN 'unverified' ELSE 'exact' END AS grounding, CAST(b.pos AS INTEGER) AS quote_start, CAST(b.pos + b.size AS INTEGER) AS quote_end,
  array_to_string(list_filter([CASE WHEN q.n % 3 = 0 THEN 'kept' END, CASE WHEN b.page_no IS NULL THEN 'quote_not_found' WHEN b.page_no <> q.page THEN 'page_corrected:' || q.page || '->' || b.page_no END,
    CASE WHEN kind = 'numeric' THEN CASE WHEN value_num IS NULL THEN 'numeric_without_value' WHEN NOT contains(regexp_replace(q.quote, '[,\s]', '', 'g'), printf('%.0f', value_num)) THEN 'value_not_in_quote' END END,
    CASE WHEN coalesce(nullif(confidence, 0), 1) < 0.7 THEN 'low_confidence' END], lambda f: f IS NOT NULL), ' ') AS flags
FROM quotes q LEFT JOIN best b ON b.fact_id = q.fact_id""")
def ground_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from all over every page, in all languages: the page, the offsets and the flags of each."""
    found = ground.ground(t.verbatim_quotes(spark, sf_dir), t.pages(spark, sf_dir), "exact")
    return found.select("fact_id", "page", "grounding", "quote_start", "quote_end", F.array_join("flags", " ").alias("flags"))


@query()
def ground_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(spark, sf_dir, "all")


@query()
def grounding_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier counts of a re-grounding run."""
    stored = t.quotes(spark, sf_dir).withColumn("page_no", F.col("page")).withColumn("chunk_id", F.concat("doc_id", F.lit(":"), "page_no", F.lit("-"), F.col("page_no") + 1)).drop("page", "page_start", "page_end")
    return report.counts_by(ground.reground(stored, t.pages(spark, sf_dir)), "grounding")


@query("WITH " + t.QUOTES_SQL + """ SELECT q.fact_id, CASE WHEN p.text IS NULL OR NOT contains(p.text, q.quote) THEN coalesce(p.text, '') ELSE substring(p.text, 1, position(q.quote IN p.text) - 1) END AS before,
  CASE WHEN contains(p.text, q.quote) THEN q.quote ELSE '' END AS marked, CASE WHEN contains(p.text, q.quote) THEN substring(p.text, position(q.quote IN p.text) + length(q.quote)) ELSE '' END AS after
FROM quotes q LEFT JOIN pages p ON p.doc_id = q.doc_id AND p.page_no = q.page""")
def evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.quotes(spark, sf_dir).withColumn("page_no", F.col("page")).withColumn("quote_start", F.lit(None).cast("int")).withColumn("quote_end", F.lit(None).cast("int"))
    return ground.evidence_view(rows, t.pages(spark, sf_dir)).select("fact_id", "before", "marked", "after")


@query("SELECT item_id, doc_id, position(b.text IN d.text) - 1 AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passages_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark passages stand verbatim."""
    return passages.locate_passages(t.table(spark, sf_dir, "benchmark").select("item_id", "text"), t.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, list_aggregate(list_transform([printf('%.0f', x), printf('%.1f', x), printf('%.2f', x), printf('%.3f', x), printf('%g', x)], lambda f: contains(digits, f)), 'bool_or') AS found FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, regexp_replace(text, '[,\\s]', '', 'g') AS digits FROM documents) d")
def numbers_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", number_in_quote(F.col("n_chars").cast("double"), "text").alias("found"))


# Facts.


@query(_ALL_CHUNKS_SQL + "SELECT chunk_id, page_start AS first_page, page_end AS last_page FROM chunk")
def pages_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a chunk's id names."""
    first, last = ground.pages_of_chunk(F.col("chunk_id"), F.lit(0))
    return all_chunks(spark, sf_dir).select("chunk_id", first.alias("first_page"), last.alias("last_page"))


@query("SELECT o_orderkey, strftime(make_date(y, 4, 1), '%Y-%m-%d') AS \"start\", strftime(make_date(y + 1, 3, 31), '%Y-%m-%d') AS \"end\" FROM (SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS INTEGER) AS y FROM orders) o")
def fiscal_year_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate") - F.when(F.month("o_orderdate") < 4, 1).otherwise(0) + 1
    label = F.concat(F.lit("fy "), year - 1, F.lit("-"), year)
    return t.table(spark, sf_dir, "orders").select("o_orderkey", norm.parse_period(label, F.lit(4)).alias("p")).select("o_orderkey", "p.start", "p.end")


_CONVENTIONS = ("Calendar year", "July to June", "October-September", "calendar year, but April to March in the annex", "")


@query("""SELECT o_orderkey, m AS first_month, strftime(make_date(y - CASE m WHEN 1 THEN 0 ELSE 1 END, m, 1), '%Y-%m-%d') AS "start", strftime(make_date(y - CASE m WHEN 1 THEN 0 ELSE 1 END, m, 1) + INTERVAL 12 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS "end",
  CASE m WHEN 1 THEN 'calendar_year' ELSE 'fiscal_year' END AS type FROM (SELECT o_orderkey, [1, 7, 10, 4, 4][o_orderkey % 5 + 1] AS m, CAST(year(o_orderdate) + 10 AS INTEGER) AS y FROM orders) o""")
def fiscal_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first month of a year from what a document says about its years, and the period of a label by it."""
    said = F.get(F.array(*map(F.lit, _CONVENTIONS)), (F.col("o_orderkey") % len(_CONVENTIONS)).cast("int"))
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", norm.fiscal_start_month(said).alias("first_month"), F.concat(F.lit("FY"), F.year("o_orderdate") + 10).alias("label"))
    return rows.select("o_orderkey", "first_month", norm.parse_period(F.col("label"), F.col("first_month")).alias("p")).select("o_orderkey", "first_month", "p.*")


@query("""SELECT o_orderkey, strftime(make_date(year(o_orderdate), 3 * q - 2, 1), '%Y-%m-%d') AS "start", strftime(last_day(make_date(year(o_orderdate), 3 * q, 1)), '%Y-%m-%d') AS "end", 'quarter' AS type
FROM (SELECT *, CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders) o""")
def quarter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("q"), F.quarter("o_orderdate"), F.lit(" fy "), F.year("o_orderdate"))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", norm.parse_period(label, F.lit(1)).alias("p")).select("o_orderkey", "p.*")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS \"start\", 'point_in_time' AS type FROM orders")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.date_format(F.add_months("o_orderdate", 240), "'as at' d MMMM, yyyy")
    return t.table(spark, sf_dir, "orders").select("o_orderkey", norm.parse_period(label, F.lit(7)).alias("p")).select("o_orderkey", "p.start", "p.type")


@query("""SELECT p_partkey, coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(lower('Total ' || p_name || ' of the-' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' '),
  lambda w: w NOT IN ('', 'the', 'of', 'for', 'in', 'as', 'at', 'on', 'and', 'to', 'a', 'an', 'total')), '_'), ''), 'unknown') AS key FROM part""")
def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Total "), "p_name", F.lit(" of the-"), "p_brand")
    return t.table(spark, sf_dir, "part").select("p_partkey", norm.attribute_key(name).alias("key"))


_NUMBERS_SQL = "WITH n AS (" + t.NUMBERS_SQL.replace("{", "").replace("}", "") + """), f AS (
  SELECT publisher || nation AS doc_id, nation, year, publisher, value_num, value_num * CASE publisher WHEN 'A' THEN 1e3 ELSE 1e6 END AS value_norm FROM n
)"""


@query(_NUMBERS_SQL + """ SELECT doc_id, 'Nation ' || nation AS scope, (SELECT n_name FROM nation WHERE n_nationkey = f.nation) AS subject, 'order_value' AS attribute_key, 'USD' AS unit, CASE publisher WHEN 'A' THEN 'thousand' ELSE 'million' END AS scale,
  round(value_norm, 2) AS value_norm, year || '-04-01' AS period_start, (year + 1) || '-03-31' AS period_end, 'fiscal_year' AS period_type, 1 AS n_flags FROM f""")
def finalize_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _numbers(spark, sf_dir)
    return made.select("doc_id", "scope", "subject", "attribute_key", "unit", "scale", F.round("value_norm", 2).alias("value_norm"), "period_start", "period_end", "period_type", F.size("flags").alias("n_flags"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.finalize_facts(t.raw_numbers(spark, sf_dir), t.publishers(spark, sf_dir))


@query(_NUMBERS_SQL + """ SELECT least(a.doc_id, b.doc_id) AS doc_a, greatest(a.doc_id, b.doc_id) AS doc_b, a.year || '-04-01' AS period_start, round(abs(a.value_norm - b.value_norm) / greatest(a.value_norm, b.value_norm, 1e-9), 6) AS delta
FROM f a JOIN f b ON a.nation = b.nation AND a.year = b.year AND a.publisher = 'A' AND b.publisher = 'B' WHERE abs(a.value_norm - b.value_norm) / greatest(a.value_norm, b.value_norm, 1e-9) <= 0.01""")
def numeric_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    names = lambda c, n: rows.select(F.col("id").alias(c), F.col("doc_id").alias(n), F.col("period_start").alias(f"{n}_start"))
    found = link.numeric_matches(rows).join(names("fact_a", "x"), "fact_a").join(names("fact_b", "y"), "fact_b")
    return found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.col("x_start").alias("period_start"), F.round("delta", 6).alias("delta"))


_TEXT_SQL = "printf('%.2f', {p}.value_num) || ' (' || CASE {p}.publisher WHEN 'A' THEN 'thousand' ELSE 'million' END || ')'"


@query(_NUMBERS_SQL + f""", p AS (SELECT least(a.doc_id, b.doc_id) AS doc_a, greatest(a.doc_id, b.doc_id) AS doc_b, a.year AS year, {_TEXT_SQL.format(p="a")} AS one, {_TEXT_SQL.format(p="b")} AS two, abs(a.value_norm - b.value_norm) / greatest(a.value_norm, b.value_norm, 1e-9) AS gap
FROM f a JOIN f b ON a.nation = b.nation AND a.year = b.year AND a.publisher = 'A' AND b.publisher = 'B')
SELECT doc_a, doc_b, 'Key order_value, period ' || year || '-04-01 to ' || (year + 1) || '-03-31 and unit USD are the same; A ' || one || ' and B ' || two || ' differ by ' || printf('%.2f', gap * 100) || '%.' AS reason FROM p WHERE gap <= 0.01""")
def numeric_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why values are held to agree, the values in order of their publishers."""
    rows = _numbers(spark, sf_dir)
    names = lambda c, n: rows.select(F.col("id").alias(c), F.col("doc_id").alias(n), F.concat("value_text", F.lit(" ("), "scale", F.lit(")")).alias(f"{n}_value"))
    found = link.numeric_matches(rows).join(names("fact_a", "x"), "fact_a").join(names("fact_b", "y"), "fact_b")
    first = F.col("x") < F.col("y")
    one, two = F.when(first, F.col("x_value")).otherwise(F.col("y_value")), F.when(first, F.col("y_value")).otherwise(F.col("x_value"))
    told = F.replace("reasoning", F.concat("x_value", F.lit(" and "), "y_value"), F.concat(F.lit("A "), one, F.lit(" and B "), two))
    return found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), told.alias("reason"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS page, role AS attribute, text AS quote FROM conversations WHERE text IS NOT NULL")
def parse_fact_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made of conversations' turns, and read again."""
    turn = F.struct(F.col("turn").cast("int").alias("page"), F.col("role").alias("attribute"), F.col("text").alias("quote"))
    rows = t.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("conv_id").alias("chunk_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.to_json(F.struct(F.array(turn).alias("facts"))).alias("response"))
    return facts.parse_fact_responses(rows)[0].select(F.col("chunk_id").alias("conv_id"), F.col("page").cast("long").alias("page"), "attribute", "quote")


# Linking.

_SIMS_SQL = ("WITH " + t.LAYER_SQL + ", v AS (SELECT f.*, CAST(e.embedding AS DOUBLE[]) AS v FROM facts f JOIN embeddings e ON e.vec_id = f.vec_id), near AS (SELECT * FROM ("
             "SELECT a.id AS fact_id, b.id AS other_id, list_inner_product(a.v, b.v) AS sim, a.kind = b.kind AS same, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS r FROM v a JOIN v b ON a.doc_id <> b.doc_id) s WHERE r <= 15 AND sim >= 0.35 AND same),"
             " alike AS (SELECT * FROM (SELECT fact_id, other_id, sim, row_number() OVER (PARTITION BY fact_id ORDER BY sim DESC, other_id) AS r FROM near) s WHERE r <= 5)")  # fmt: skip
_KEYED_SQL = (", keyed AS (SELECT * FROM (SELECT a.id AS fact_id, b.id AS other_id, list_inner_product(a.v, b.v) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS r"
              " FROM v a JOIN v b ON a.attribute_key = b.attribute_key AND a.kind = b.kind AND a.doc_id <> b.doc_id) s WHERE r <= 9)")  # fmt: skip
_RANKED_SQL = ", both_ AS (SELECT fact_id, other_id, max(sim) AS sim, max(via) AS via FROM (SELECT fact_id, other_id, sim, 'similarity' AS via FROM alike UNION ALL SELECT fact_id, other_id, sim, 'key' FROM keyed) u GROUP BY 1, 2), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY sim DESC, other_id) AS rank FROM both_) s WHERE rank <= 9)"
THRESHOLD = 0.35


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches read of the facts. They read it several times, so it is written and vectors are joined to their facts once."""
    path = tables.workspace(spark)
    t.facts(spark, sf_dir).select("fact_id", "doc_id", "doc_seq", "kind", "attribute_key", "embedding").write.parquet(path)
    return spark.read.parquet(path)


@query(_SIMS_SQL + " SELECT fact_id, other_id, round(sim, 6) AS sim FROM alike")
def similarity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.similarity_candidates(_searched(spark, sf_dir), THRESHOLD).withColumn("sim", F.round("sim", 6))


@query(_SIMS_SQL + _KEYED_SQL + " SELECT fact_id, other_id, round(sim, 6) AS sim FROM keyed")
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.key_candidates(_searched(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query((_SIMS_SQL + _KEYED_SQL).replace("a.kind = b.kind AND a.doc_id <> b.doc_id", "a.kind = b.kind AND b.doc_seq < a.doc_seq") + " SELECT fact_id, other_id, round(sim, 6) AS sim FROM keyed")
def key_candidates_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As documents arrive: only facts of earlier documents are candidates."""
    return link.key_candidates(_searched(spark, sf_dir), "incremental").withColumn("sim", F.round("sim", 6))


@query("SELECT vec_id, round(list_sum(list_transform(u, x -> x * x)), 6) AS squares, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, x -> 3 * x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, y -> 9 * y::DOUBLE * y::DOUBLE))), 1e-9)) AS u FROM embeddings) e".replace("x ->", "lambda x:").replace("y ->", "lambda y:"))
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of three times their length, scaled to unit length."""
    unit = link.unit_length(F.transform("embedding", lambda x: x.cast("double") * 3))
    return t.table(spark, sf_dir, "embeddings").withColumn("u", unit).select("vec_id", F.round(link.dot(F.col("u"), F.col("u")), 6).alias("squares"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def _last_document(rows: DataFrame) -> DataFrame:
    """The facts of the document that came last."""
    return rows.join(rows.agg(F.max("doc_seq").alias("doc_seq")), "doc_seq", "left_semi")


@query(_SIMS_SQL.replace("ON a.doc_id <> b.doc_id)", "ON b.doc_seq < a.doc_seq AND a.doc_seq = (SELECT max(doc_seq) FROM facts))") + " SELECT fact_id, other_id, round(sim, 6) AS sim FROM alike")
def similarity_candidates_of_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the facts of the last document ask, and only earlier documents answer."""
    rows = _searched(spark, sf_dir)
    return link.similarity_candidates(rows, THRESHOLD, mode="incremental", asking=_last_document(rows)).withColumn("sim", F.round("sim", 6))


@query((_SIMS_SQL + _KEYED_SQL).replace("a.kind = b.kind AND a.doc_id <> b.doc_id", "a.kind = b.kind AND b.doc_seq < a.doc_seq AND a.doc_seq = (SELECT max(doc_seq) FROM facts)") + " SELECT fact_id, other_id, round(sim, 6) AS sim FROM keyed")
def key_candidates_of_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searched(spark, sf_dir)
    return link.key_candidates(rows, "incremental", asking=_last_document(rows)).withColumn("sim", F.round("sim", 6))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searched(spark, sf_dir)
    return link.rank_candidates(link.similarity_candidates(rows, THRESHOLD), link.key_candidates(rows))


@query(_SIMS_SQL + _KEYED_SQL + _RANKED_SQL + " SELECT fact_id, other_id, round(sim, 6) AS sim, via, CAST(rank AS INTEGER) AS rank FROM ranked")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).withColumn("sim", F.round("sim", 6))


@query(_SIMS_SQL + _KEYED_SQL + _RANKED_SQL + " SELECT DISTINCT least(fact_id, other_id) AS fact_a, greatest(fact_id, other_id) AS fact_b FROM ranked c WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.fact_a = least(c.fact_id, c.other_id) AND r.fact_b = greatest(c.fact_id, c.other_id))")
def open_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs that have no relation yet."""
    return link.as_pairs(link.not_judged(_ranked(spark, sf_dir), t.relations(spark, sf_dir)))


_AGREE_SQL = ("coalesce(a.kind = 'numeric' AND b.kind = 'numeric' AND a.unit = b.unit AND a.attribute_key = b.attribute_key AND lower(a.scope) = lower(b.scope) AND a.period_start <> '' AND a.period_end <> '' AND a.period_start = b.period_start AND a.period_end = b.period_end"
              " AND (lower(a.basis) = lower(b.basis) OR a.basis = '' OR b.basis = '') AND abs(a.value_norm - b.value_norm) / greatest(abs(a.value_norm), abs(b.value_norm), 1e-9) <= 0.5, false)")  # fmt: skip
_JUDGED_SQL = _SIMS_SQL + _KEYED_SQL + _RANKED_SQL + f", judged AS (SELECT c.*, a.doc_id, a.page_no, a.quote_start, {_AGREE_SQL} AS settled FROM ranked c JOIN facts a ON a.id = c.fact_id JOIN facts b ON b.id = c.other_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.judge_numeric(_ranked(spark, sf_dir), t.facts(spark, sf_dir).drop("embedding", "fact_id"), tolerance=0.5)


@query(_JUDGED_SQL + " SELECT fact_id, other_id, settled FROM judged")
def judge_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("fact_id", "other_id", "settled")


@query(_JUDGED_SQL + " SELECT f.doc_id, count(*) AS new_facts, CAST((SELECT count(*) FROM judged j WHERE j.doc_id = f.doc_id) AS BIGINT) AS candidates, CAST((SELECT count(*) FROM judged j WHERE j.doc_id = f.doc_id AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.fact_a = least(j.fact_id, j.other_id) AND r.fact_b = greatest(j.fact_id, j.other_id))) AS BIGINT) AS not_judged,"
       " CAST((SELECT count(*) FROM judged j WHERE j.doc_id = f.doc_id AND settled) AS BIGINT) AS settled, CAST((SELECT count(DISTINCT fact_id) FROM judged j WHERE j.doc_id = f.doc_id AND NOT settled) AS BIGINT) AS groups FROM facts f GROUP BY f.doc_id")  # fmt: skip
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = t.facts(spark, sf_dir), tables.workspace(spark)
    _ranked(spark, sf_dir).write.parquet(path)  # searched once for all that is counted
    ranked = spark.read.parquet(path)
    judged = link.judge_numeric(ranked, rows.drop("embedding", "fact_id"), tolerance=0.5)
    return link.link_stats(rows.drop("fact_id"), ranked, link.not_judged(ranked, t.relations(spark, sf_dir)), judged)


@query(_JUDGED_SQL + ", det AS (SELECT DISTINCT least(fact_id, other_id) AS fact_a, greatest(fact_id, other_id) AS fact_b FROM judged WHERE settled), old AS (SELECT fact_a, fact_b, type, method FROM relations) SELECT * FROM old UNION ALL SELECT d.fact_a, d.fact_b, 'corroborates', 'deterministic' FROM det d ANTI JOIN old r ON r.fact_a = d.fact_a AND r.fact_b = d.fact_b")
def link_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, less those that are judged, settled by arithmetic where it can, and the relation table after that."""
    current = t.relations(spark, sf_dir).select("fact_a", "fact_b", "type", "method")
    return link.link_run(_ranked(spark, sf_dir), t.facts(spark, sf_dir).drop("embedding", "fact_id"), current, tolerance=0.5)[0]


@query("WITH " + t.LAYER_SQL + " SELECT id, subject || ' | ' || attribute AS label FROM facts")
def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.facts(spark, sf_dir).select("id", link.fact_text(F.col("subject"), F.col("attribute")).alias("label"))


@query("WITH " + t.LAYER_SQL + " SELECT doc_id, title || ' · report · published ' || publication_date AS label FROM docs")
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.documents(spark, sf_dir).select("doc_id", requests.doc_label(F.col("title"), F.col("filename"), F.lit("report"), F.col("publication_date")).alias("label"))


@query(_JUDGED_SQL + ", old AS (SELECT DISTINCT fact_a, fact_b FROM relations), fresh AS (SELECT j.*, least(fact_id, other_id) AS pa, greatest(fact_id, other_id) AS pb FROM judged j WHERE NOT EXISTS (SELECT 1 FROM old r WHERE r.fact_a = least(j.fact_id, j.other_id) AND r.fact_b = greatest(j.fact_id, j.other_id))),"
       " once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pa, pb ORDER BY doc_id, fact_id) AS k FROM fresh) s WHERE k = 1)"
       " SELECT f.doc_id, count(*) AS new_facts, CAST((SELECT count(*) FROM judged j WHERE j.doc_id = f.doc_id) AS BIGINT) AS candidates, CAST((SELECT count(DISTINCT e.fact_a || '/' || e.fact_b) FROM ends e JOIN facts x ON x.id = e.fact_id WHERE x.doc_id = f.doc_id) AS BIGINT) AS already_judged,"
       " CAST((SELECT count(DISTINCT fact_id) FROM once o WHERE o.doc_id = f.doc_id AND NOT settled) AS BIGINT) AS groups, CAST((SELECT count(*) FROM relations r JOIN facts x ON x.id = r.fact_a WHERE x.doc_id = f.doc_id AND method = 'llm') AS BIGINT) AS llm_relations,"
       " CAST((SELECT count(*) FROM once o WHERE o.doc_id = f.doc_id AND settled) AS BIGINT) AS deterministic_relations FROM facts f GROUP BY f.doc_id")  # fmt: skip
def link_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a link run has done for each document, read back from its events. The relations that the model has given are those of the table."""
    rows, relations = t.facts(spark, sf_dir), t.relations(spark, sf_dir)
    pairs = relations.select("fact_a", "fact_b", F.lit(True).alias("known")).distinct()
    found = _judged(spark, sf_dir).withColumns({"fact_a": F.least("fact_id", "other_id"), "fact_b": F.greatest("fact_id", "other_id")}).join(pairs, ["fact_a", "fact_b"], "left")
    judged = relations.where("method = 'llm'").join(rows.select(F.col("id").alias("fact_a"), "doc_id"), "fact_a")
    return link.run_totals(link.run_events(rows, found.withColumn("known", F.coalesce("known", F.lit(False))), relations, F.lit(1), judged))


_BATCHES_SQL = _JUDGED_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(fact_id, other_id), greatest(fact_id, other_id) ORDER BY fact_id) AS k FROM judged WHERE NOT settled) s WHERE k = 1
), g AS (
  SELECT doc_id, fact_id, count(*) + 1 AS size, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, quote_start NULLS FIRST, fact_id) AS k FROM once GROUP BY doc_id, page_no, quote_start, fact_id
), w AS (
  SELECT doc_id, fact_id, size, k, CAST(size AS BIGINT) AS total, CAST(0 AS BIGINT) AS batch FROM g WHERE k = 1
  UNION ALL
  SELECT g.doc_id, g.fact_id, g.size, g.k, CASE WHEN w.total + g.size > 40 THEN g.size ELSE w.total + g.size END, CASE WHEN w.total + g.size > 40 THEN w.batch + 1 ELSE w.batch END FROM w JOIN g ON g.doc_id = w.doc_id AND g.k = w.k + 1
), b AS (SELECT doc_id, CAST(batch AS INTEGER) AS batch, CAST(row_number() OVER (PARTITION BY doc_id, batch ORDER BY k) - 1 AS INTEGER) AS nth, fact_id, CAST(size AS BIGINT) AS size FROM w)"""


@query(_BATCHES_SQL + " SELECT * FROM b")
def judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.judge_batches(_judged(spark, sf_dir))


_LINE_SQL = """'- id=' || id || ' | doc=' || {tag} || ' | page ' || page_no || chr(10) || '  subject: ' || subject || ' | attribute: ' || attribute || ' | value: '
|| CASE WHEN kind = 'numeric' THEN trim(value_text || ' ' || unit || ' ' || CASE scale WHEN 'none' THEN '' ELSE scale END) ELSE value_text END || ' | period: ' || CASE WHEN period_label = '' THEN '-' ELSE period_label END
|| CASE WHEN period_start = '' THEN '' ELSE ' (' || period_start || '..' || period_end || ')' END || ' | basis: ' || CASE WHEN basis = '' THEN '-' ELSE basis END || ' | scope: ' || CASE WHEN scope = '' THEN '-' ELSE scope END
|| chr(10) || '  quote: "' || left(quote, 300) || '"'"""


@query(_BATCHES_SQL + """, m AS (
  SELECT doc_id, batch, nth, 0 AS place, fact_id FROM b UNION ALL SELECT b.doc_id, b.batch, b.nth, o.rank, o.other_id FROM b JOIN once o ON o.fact_id = b.fact_id
), t AS (
  SELECT *, 'D' || row_number() OVER (PARTITION BY doc_id, batch ORDER BY fact_doc) AS tag FROM (SELECT DISTINCT m.doc_id, batch, f.doc_id AS fact_doc FROM m JOIN facts f ON f.id = m.fact_id) s
), l AS (
  SELECT t.doc_id, t.batch, string_agg(tag || ': ' || title || ' · report · published ' || publication_date || chr(10) || '    period covered: 2023-04-01..?' || CASE WHEN fact_doc = 'd3' THEN '' ELSE chr(10) || '    year convention: April' END, chr(10) ORDER BY fact_doc) AS legend
  FROM t JOIN docs ON docs.doc_id = t.fact_doc GROUP BY 1, 2
), lines AS (
  SELECT m.doc_id, m.batch, nth, '### Group ' || (nth + 1) || chr(10) || string_agg(""" + _LINE_SQL.format(tag="tag") + """, chr(10) ORDER BY place, m.fact_id) AS text
  FROM m JOIN facts f ON f.id = m.fact_id JOIN t ON t.doc_id = m.doc_id AND t.batch = m.batch AND t.fact_doc = f.doc_id GROUP BY 1, 2, 3
)
SELECT l.doc_id, l.batch, 'Documents:' || chr(10) || legend || chr(10) || chr(10) || 'Fact groups (compare facts within a group, across documents only):' || chr(10) || chr(10) || body AS prompt
FROM l JOIN (SELECT doc_id, batch, string_agg(text, chr(10) || chr(10) ORDER BY nth) AS body FROM lines GROUP BY 1, 2) x ON x.doc_id = l.doc_id AND x.batch = l.batch""")  # fmt: skip
def judgement_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that go to the judge."""
    judged, own = _judged(spark, sf_dir), {"title": F.col("title"), "publication_date": F.col("publication_date"), "doc_type": F.lit("report"), "period_covered_start": F.lit("2023-04-01")}
    own["fiscal_year_convention"] = F.when(F.col("doc_id") == "d3", "").otherwise("April")
    meta = F.struct(*(own.get(k, F.lit("")).alias(k) for k in requests.CONTEXT_KEYS))
    members = link.batch_members(link.judge_batches(judged), judged)
    return requests.judgement_requests(members, t.facts(spark, sf_dir), t.documents(spark, sf_dir).select("doc_id", "filename", meta.alias("meta")))[0]


_UPSERT_SQL = "WITH " + t.LAYER_SQL + """, det AS (SELECT fact_a, fact_b FROM relations WHERE created_at % 5 = 0 UNION SELECT fact_b || 'x', fact_a FROM relations WHERE created_at % 7 = 0),
llm AS (SELECT fact_a, fact_b, 'contradicts' AS type FROM relations WHERE created_at % 2 = 0),
step AS (SELECT fact_a, fact_b, type, method FROM relations UNION ALL SELECT d.fact_a, d.fact_b, 'corroborates', 'deterministic' FROM det d ANTI JOIN relations r ON r.fact_a = d.fact_a AND r.fact_b = d.fact_b),
fresh AS (SELECT l.* FROM llm l ANTI JOIN (SELECT * FROM step WHERE method = 'deterministic') s ON s.fact_a = l.fact_a AND s.fact_b = l.fact_b)
SELECT s.fact_a, s.fact_b, s.type, s.method FROM step s ANTI JOIN fresh f ON f.fact_a = s.fact_a AND f.fact_b = s.fact_b UNION ALL SELECT fact_a, fact_b, type, 'llm' FROM fresh"""


@query(_UPSERT_SQL)
def upsert_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = t.relations(spark, sf_dir).select("fact_a", "fact_b", "type", "method", "created_at")
    table = current.drop("created_at")
    some = current.where("created_at % 5 = 0").select("fact_a", "fact_b").union(current.where("created_at % 7 = 0").select(F.concat("fact_b", F.lit("x")), "fact_a")).distinct()
    settled = some.withColumn("type", F.lit("corroborates")).withColumn("method", F.lit("deterministic"))
    judged = current.where("created_at % 2 = 0").select("fact_a", "fact_b", F.explode(F.array(F.lit("unrelated"), F.lit("contradicts"))).alias("type"), F.lit("llm").alias("method"), F.lit("b").alias("batch_id"))
    return link.upsert_relations(table, settled, judged.withColumn("position", F.when(F.col("type") == "contradicts", 2).otherwise(1)))


@query("WITH " + t.LAYER_SQL + " SELECT r.fact_a, r.fact_b, r.type FROM relations r JOIN facts a ON a.id = r.fact_a JOIN facts b ON b.id = r.fact_b WHERE a.doc_id <> b.doc_id AND a.vec_id // 10 = b.vec_id // 10")
def validate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses for batches of ten facts, written as JSON and read again; pairs across batches aren't valid."""
    batch = lambda c: F.floor(F.col(c).cast("long") / 10).cast("string")
    body = F.to_json(F.struct(F.array(F.struct(F.col("fact_b").alias("a"), F.col("fact_a").alias("b"), "type", "reconciliation", "confidence", "reasoning")).alias("relations")))
    read = facts.parse_relation_responses(t.relations(spark, sf_dir).select(batch("fact_a").alias("batch_id"), body.alias("response")))
    return link.validate_relations(read, t.facts(spark, sf_dir).select(batch("id").alias("batch_id"), "fact_id", "doc_id")).select("fact_a", "fact_b", "type")


@query("WITH " + t.LAYER_SQL + """ SELECT id, '- id=' || id || ' | doc=' || doc_id || ' | page ' || page_no || chr(10) || '  subject: ' || subject || ' | attribute: ' || attribute || ' | value: '
|| CASE WHEN kind = 'numeric' THEN trim(value_text || ' ' || unit || ' ' || CASE scale WHEN 'none' THEN '' ELSE scale END) ELSE value_text END || ' | period: ' || CASE WHEN period_label = '' THEN '-' ELSE period_label END
|| CASE WHEN period_start = '' THEN '' ELSE ' (' || period_start || '..' || period_end || ')' END || ' | basis: ' || CASE WHEN basis = '' THEN '-' ELSE basis END || ' | scope: ' || CASE WHEN scope = '' THEN '-' ELSE scope END
|| chr(10) || '  quote: "' || left(quote, 300) || '"' AS line FROM facts""")
def judgement_fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.facts(spark, sf_dir).select("id", requests.fact_line(F.col("doc_id")).alias("line"))


# Reports.

_L = "WITH " + t.LAYER_SQL


@query(_L + " SELECT f.id, d.filename AS doc_filename, d.title AS doc_title, d.publication_date AS doc_date, CAST(coalesce(c.n, 0) AS BIGINT) AS rel_count FROM facts f JOIN docs d ON d.doc_id = f.doc_id LEFT JOIN (SELECT fact_id, count(*) AS n FROM ends WHERE type <> 'unrelated' GROUP BY 1) c ON c.fact_id = f.id")
def facts_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_doc_columns(t.facts(spark, sf_dir), t.documents(spark, sf_dir), t.relations(spark, sf_dir)).select("id", "doc_filename", "doc_title", "doc_date", "rel_count")


@query(_L + " SELECT id, doc_id, page_no, quote_start FROM facts WHERE kind = 'numeric' AND len(flags) > 0 AND lower(quote) LIKE '%quote 1%' ORDER BY doc_id, page_no, quote_start NULLS FIRST, id LIMIT 50 OFFSET 10")
def search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.search_facts(t.facts(spark, sf_dir), q="QUOTE 1", flagged=True, kind="numeric")
    return report.page_of_facts(found, 50, 10).select("id", "doc_id", "page_no", "quote_start")


@query(_L + " SELECT r.fact_a, r.fact_b, r.confidence FROM relations r JOIN facts a ON a.id = r.fact_a JOIN facts b ON b.id = r.fact_b WHERE r.type <> 'unrelated' AND method = 'llm' AND (a.doc_id = 'd3' OR b.doc_id = 'd3') AND (lower(a.attribute) LIKE '%key_1%' OR lower(b.attribute) LIKE '%key_1%' OR lower(reasoning) LIKE '%key_1%' OR lower(a.subject) LIKE '%key_1%') ORDER BY r.confidence DESC, r.created_at, r.fact_a, r.fact_b LIMIT 40")
def search_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = report.attach_facts(t.relations(spark, sf_dir), t.facts(spark, sf_dir).drop("embedding"))
    return report.page_of_relations(report.search_relations(attached, method="llm", doc_id="d3", q="key_1"), 40).select("fact_a", "fact_b", "confidence")


@query(_L + " SELECT r.fact_a, r.fact_b, a.doc_id AS doc_a, b.doc_id AS doc_b FROM relations r JOIN facts a ON a.id = r.fact_a JOIN facts b ON b.id = r.fact_b")
def attach_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = report.attach_facts(t.relations(spark, sf_dir), t.facts(spark, sf_dir).select("id", "doc_id"))
    return attached.select("fact_a", "fact_b", F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))


@query(_L + " SELECT DISTINCT fact_a, fact_b FROM ends WHERE fact_id IN (SELECT id FROM facts WHERE grounding = 'window')")
def relations_of_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.relations_for(t.relations(spark, sf_dir), t.facts(spark, sf_dir).where("grounding = 'window'")).select("fact_a", "fact_b")


@query(_L + """ SELECT d.doc_id, d.status, CAST(coalesce(f.n, 0) AS BIGINT) AS facts, CAST(coalesce(f.u, 0) AS BIGINT) AS unverified, CAST(coalesce(r.n, 0) AS BIGINT) AS relations FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE grounding = 'unverified') AS u FROM facts GROUP BY 1) f ON f.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT fact_a, fact_b, f.doc_id FROM ends e JOIN facts f ON f.id = e.fact_id WHERE type <> 'unrelated') s GROUP BY 1) r ON r.doc_id = d.doc_id""")
def document_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.document_overview(t.documents(spark, sf_dir).select("doc_id", "status"), t.facts(spark, sf_dir), t.relations(spark, sf_dir))


@query(_L + """ SELECT count(*) AS n, count(*) FILTER (WHERE kind = 'numeric') AS numeric, count(*) FILTER (WHERE kind = 'statement') AS statement, count(*) FILTER (WHERE grounding = 'exact') AS exact, count(*) FILTER (WHERE grounding = 'fuzzy') AS fuzzy,
count(*) FILTER (WHERE grounding = 'window') AS window, count(*) FILTER (WHERE grounding = 'unverified') AS unverified, count(*) FILTER (WHERE len(flags) > 0) AS flagged, CAST(round(100.0 * count(*) FILTER (WHERE grounding <> 'unverified') / count(*)) AS BIGINT) AS grounded_percent FROM facts""")
def fact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.fact_totals(t.facts(spark, sf_dir))


@query(_L + " SELECT status, count(*) AS n FROM docs GROUP BY 1")
def documents_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by(t.documents(spark, sf_dir), "status")


@query(_L + " SELECT type, method, count(*) AS n FROM relations GROUP BY 1, 2")
def relations_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by(t.relations(spark, sf_dir), "type", "method")


@query(_L + " SELECT reconciliation, count(*) AS n FROM relations WHERE type = 'reconciled' GROUP BY 1 ORDER BY n DESC, reconciliation")
def reconciliation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reconciliation_kinds(t.relations(spark, sf_dir))


@query(_L + " SELECT kind, grounding, count(*) AS n FROM facts GROUP BY 1, 2")
def facts_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by(t.facts(spark, sf_dir), "kind", "grounding")


@query(_L + " SELECT string_split(f, ':')[1] AS flag, count(*) AS n FROM (SELECT unnest(flags) AS f FROM facts) s GROUP BY 1")
def flag_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flag_families(t.facts(spark, sf_dir))


_CALLS = "WITH calls AS (" + t.CALLS_SQL.replace("{", "").replace("}", "") + ")"


@query(_CALLS + " SELECT purpose, model, count(*) AS calls, count(*) FILTER (WHERE ok) AS ok, round(sum(cost_usd), 3) AS usd, round(avg(duration_ms) / 1000, 1) AS avg_s FROM calls GROUP BY 1, 2")
def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.call_totals(t.calls(spark, sf_dir))


@query(_CALLS + " SELECT created_at, model, duration_ms FROM calls WHERE NOT ok ORDER BY created_at DESC, purpose, model, duration_ms LIMIT 15")
def failed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failed_calls(t.calls(spark, sf_dir)).select("created_at", "model", "duration_ms")


_SHOWN = _L + ", s AS (SELECT r.*, a.scale AS sa, b.scale AS sb, a.unit AS ua, b.unit AS ub, a.value_text AS va, b.value_text AS vb, a.attribute AS aa, b.attribute AS ab, a.kind AS ka FROM relations r JOIN facts a ON a.id = r.fact_a JOIN facts b ON b.id = r.fact_b WHERE cross_document AND a.grounding <> 'unverified' AND b.grounding <> 'unverified')"


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.attach_facts(t.relations(spark, sf_dir), t.facts(spark, sf_dir).drop("embedding"))


@query(_SHOWN + " SELECT fact_a, fact_b, confidence FROM s WHERE type = 'corroborates' AND method = 'llm' ORDER BY (sa <> sb OR ua <> ub) DESC, (va <> vb OR aa <> ab) DESC, (ka = 'statement') DESC, confidence DESC, fact_a, fact_b LIMIT 12")
def showcase_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.showcase_corroborated(_attached(spark, sf_dir)).select("fact_a", "fact_b", "confidence")


@query(_SHOWN + " SELECT fact_a, fact_b, confidence FROM s WHERE type = 'contradicts' ORDER BY confidence DESC, fact_a, fact_b LIMIT 12")
def showcase_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.showcase_contradictions(_attached(spark, sf_dir)).select("fact_a", "fact_b", "confidence")


@query(_SHOWN + """ SELECT reconciliation, CAST(nth AS INTEGER) AS nth, fact_a, fact_b FROM (SELECT *, row_number() OVER (PARTITION BY reconciliation ORDER BY confidence DESC, fact_a, fact_b) AS nth FROM s WHERE type = 'reconciled') q WHERE nth <= 2
ORDER BY list_position(['vintage', 'definition', 'scope', 'unit', 'estimate_vs_actual', 'rounding', 'period', 'other'], reconciliation), nth LIMIT 15""")
def showcase_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.showcase_reconciled(_attached(spark, sf_dir)).select("reconciliation", "nth", "fact_a", "fact_b")


_TOP = "SELECT '{c}' AS \"case\", CAST(row_number() OVER (ORDER BY {o}) AS INTEGER) AS nth, id FROM (SELECT * FROM facts WHERE {w} ORDER BY {o} LIMIT 15) x"


@query(_L + " " + " UNION ALL ".join(_TOP.format(c=c, o=o, w=w) for c, o, w in (("quote_not_found", "confidence DESC, id", "grounding = 'unverified'"), ("value_not_in_quote", "id", "list_contains(flags, 'value_not_in_quote')"), ("page_corrected", "id", "list_contains(flags, 'page_corrected:1->2')"), ("low_confidence", "confidence, id", "list_contains(flags, 'low_confidence')"))))
def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failure_report(t.facts(spark, sf_dir))


@query(_L + " SELECT fact_a, fact_b FROM relations WHERE type = 'unrelated' ORDER BY confidence DESC, fact_a, fact_b LIMIT 10")
def unrelated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.unrelated_matches(t.relations(spark, sf_dir)).select("fact_a", "fact_b")


@query(_L + """, ff AS (SELECT f.*, d.publication_date, d.created_at FROM facts f JOIN docs d ON d.doc_id = f.doc_id), sib AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attribute_key, kind ORDER BY period_start NULLS FIRST, created_at NULLS FIRST, id) AS r FROM ff) s WHERE r <= 200),
links AS (SELECT DISTINCT fact_id AS anchor, other_id AS id, type FROM ends WHERE type <> 'unrelated'), m AS (SELECT a.id AS anchor, b.id FROM ff a JOIN sib b ON a.attribute_key = b.attribute_key AND a.kind = b.kind WHERE a.grounding = 'window' UNION SELECT l.anchor, l.id FROM links l JOIN ff a ON a.id = l.anchor AND a.grounding = 'window')
SELECT m.anchor, CAST(row_number() OVER (PARTITION BY m.anchor ORDER BY coalesce(nullif(f.period_start, ''), '9999'), coalesce(f.period_end, ''), coalesce(f.publication_date, ''), f.id) AS INTEGER) AS nth, f.id, l.type, f.id = m.anchor AS is_anchor FROM m JOIN ff f ON f.id = m.id LEFT JOIN links l ON l.anchor = m.anchor AND l.id = m.id""")
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.facts(spark, sf_dir)
    return report.timelines(rows.where("grounding = 'window'"), rows, t.relations(spark, sf_dir), t.documents(spark, sf_dir))


# The tables themselves.


@query("SELECT sha256(text)[1:12] AS doc_id, sha256(text) AS sha256, CAST(min(doc_id) AS VARCHAR) AS filename FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY text")
def register_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content; those whose content a third of the table already holds aren't new."""
    rows = t.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("filename"), F.col("text").alias("content"), "doc_id")
    stored = tables.register_documents(rows.where("doc_id % 3 = 0").drop("doc_id"), spark.createDataFrame([], "doc_id string, status string")).withColumn("status", F.lit("done"))
    return tables.register_documents(rows.drop("doc_id"), stored).select("doc_id", "sha256", F.col("filename").cast("long").cast("string").alias("filename"))


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'not a document of the right kind' WHEN n_chars > 4000 THEN 'too large' WHEN len(string_split(text, chr(10))) > 9 THEN 'too many pages' END AS reject_reason FROM documents WHERE text IS NOT NULL")
def admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("source").isin("src1", "src2"), "a.txt").otherwise("a.PDF")
    rows = t.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", name.alias("filename"), F.col("n_chars").alias("size_bytes"), F.size(F.split("text", "\n", -1)).alias("page_count"))
    return tables.admit(rows, max_mb=4000 / 1024 / 1024, max_pages=9).select("doc_id", "reject_reason")


@query(_L + " SELECT fact_a, fact_b FROM relations WHERE fact_a NOT IN (SELECT id FROM facts WHERE doc_id = 'd2') AND fact_b NOT IN (SELECT id FROM facts WHERE doc_id = 'd2')")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations that are left when a document goes."""
    docs = t.documents(spark, sf_dir)
    layer = {"documents": docs, "pages": docs.select("doc_id"), "facts": t.facts(spark, sf_dir), "relations": t.relations(spark, sf_dir)}
    return tables.delete_documents(layer, docs.where("doc_id = 'd2'"))["relations"].select("fact_a", "fact_b")


@query("SELECT CAST(user_id AS VARCHAR) AS doc_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("props").alias("error"))
    return tables.current_status(rows).select("doc_id", "status")


@query("WITH " + t.PAGES_SQL + " SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def page_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's page maps, summed up."""
    maps = tables.page_maps(t.pages(spark, sf_dir))
    chars = F.aggregate(F.map_values("pages"), F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return maps.select("doc_id", F.size("pages").cast("long").alias("n"), chars.alias("chars"))


@query(_L + " SELECT id, doc_id, page_no, quote_start FROM facts WHERE doc_id NOT IN ('d2', 'd5')")
def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written to a table of buckets, from which two documents are deleted."""
    path = tables.workspace(spark)
    tables.write_facts(t.facts(spark, sf_dir), path)
    tables.delete_stored(spark, path, t.documents(spark, sf_dir).where("doc_id IN ('d2', 'd5')"))
    return spark.read.parquet(path).select("id", "doc_id", "page_no", "quote_start")


@query("WITH " + t.PAGES_SQL + " SELECT doc_id, page_no, text FROM pages")
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written, and read with their schema."""
    path = tables.workspace(spark)
    t.pages(spark, sf_dir).write.parquet(path)
    return tables.read_pages(spark, path)


@query("WITH " + t.PAGES_SQL + " SELECT doc_id, page_no, text FROM pages")
def exported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's page maps, read back from their JSON lines."""
    path = tables.workspace(spark)
    tables.export_json({"pages": t.pages(spark, sf_dir)}, path)
    maps = spark.read.schema("doc_id string, pages map<string, string>").json(f"{path}/pages")
    return maps.select("doc_id", F.explode("pages").alias("no", "text")).select("doc_id", F.col("no").cast("int").alias("page_no"), "text")


@query(_CALLS + " SELECT purpose, model, ok, count(*) * 2 AS n, round(sum(cost_usd) * 2, 4) AS usd FROM calls GROUP BY 1, 2, 3")
def logged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of calls after two runs have added to it."""
    path = tables.workspace(spark)
    for _ in range(2):
        tables.append_calls(t.calls(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("purpose", "model", "ok").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("usd"))


@query(_L + " SELECT id, doc_id, page_no, quote_start FROM facts ORDER BY doc_id, page_no, quote_start NULLS LAST, id")
def facts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.facts_in_order(t.facts(spark, sf_dir)).select("id", "doc_id", "page_no", "quote_start")


# Streams. The tables' rows arrive in three parts; what is there of one is one micro-batch, in however many files it comes.


def _arriving(rows: DataFrame, part: Column, path: str, *columns: str) -> Iterator[int]:
    """rows in three parts by a column that is 0, 1 or 2: yields after each one has been added to path."""
    for n in range(3):
        rows.where(part == n).select(*columns).write.mode("append").parquet(path)
        yield n


_STREAM_SQL = """, g AS (
  SELECT substr(sha256(doc_id || chr(31) || publisher || '-' || nation || '-' || year || chr(31) || year), 1, 12) AS id, doc_id, nation % 3 AS file, nation, year, publisher, value_norm FROM f
), c AS (
  SELECT a.id AS fact_id, b.id AS other_id, a.doc_id, a.nation = b.nation AND a.year = b.year AND abs(a.value_norm - b.value_norm) / greatest(abs(a.value_norm), abs(b.value_norm), 1e-9) <= 0.01 AS settled,
    row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rank FROM g a JOIN g b ON (b.file, b.doc_id) < (a.file, a.doc_id)
), r AS (SELECT * FROM c WHERE rank <= 9)"""


def _streamed(spark: SparkSession, sf_dir: str) -> linking.Layer:
    """The numbers' documents, a page each, streamed and linked; the stream is started again after its end, which changes nothing."""
    documents, raw, path = t.publishers(spark, sf_dir), t.raw_numbers(spark, sf_dir), tables.workspace(spark)
    nation = F.substring("doc_id", 2, 9).cast("int")
    pages = documents.select("doc_id", F.lit(1).alias("page_no"), F.concat(F.lit("Figures of "), "doc_id").alias("text"))
    raw.write.parquet(f"{path}/raw")
    for _ in chain(_arriving(pages, nation % 3, f"{path}/in", *schemas.PAGES.fieldNames()), ["again"]):
        linking.stream_link(spark, ingest.page_stream(spark, f"{path}/in", schemas.PAGES, None), spark.read.parquet(f"{path}/raw"), documents, f"{path}/layer", f"{path}/checkpoint", "exact", buckets=4).awaitTermination()
    return linking.Layer(spark, f"{path}/layer", 4)


@query(_NUMBERS_SQL + _STREAM_SQL + " SELECT DISTINCT least(fact_id, other_id) AS fact_a, greatest(fact_id, other_id) AS fact_b, doc_id, 'corroborates' AS type, 'deterministic' AS method FROM r WHERE settled")
def streamed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of arriving documents ask those of earlier ones; what arithmetic settles is stored once."""
    return _streamed(spark, sf_dir).relations.read(linking.RELATIONS).select("fact_a", "fact_b", "doc_id", "type", "method")


@query(_NUMBERS_SQL + _STREAM_SQL + """ SELECT g.doc_id, count(*) AS new_facts, CAST((SELECT count(*) FROM r WHERE r.doc_id = g.doc_id) AS BIGINT) AS candidates, CAST(0 AS BIGINT) AS already_judged,
  CAST((SELECT count(DISTINCT fact_id) FROM r WHERE r.doc_id = g.doc_id AND NOT settled) AS BIGINT) AS groups, CAST(0 AS BIGINT) AS llm_relations, CAST((SELECT count(*) FROM r WHERE r.doc_id = g.doc_id AND settled) AS BIGINT) AS deterministic_relations FROM g GROUP BY g.doc_id""")
def streamed_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the micro-batches did, read back from their log."""
    return link.run_totals(spark.read.parquet(f"{_streamed(spark, sf_dir).folder}/runs"))


@query("SELECT substr(sha256(text), 1, 12) AS doc_id, sha256(text) AS sha256, arg_min(CAST(doc_id AS VARCHAR), (doc_id % 3) * 1000000000 + doc_id) AS filename FROM documents WHERE text IS NOT NULL GROUP BY text")
def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that arrive in several parts are registered once, under the name with which they came first."""
    path = tables.workspace(spark)
    rows = t.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("filename"), F.col("text").alias("content"))
    for _ in _arriving(rows, F.col("doc_id") % 3, f"{path}/in", "filename", "content"):
        source = spark.readStream.schema("filename string, content string").parquet(f"{path}/in")
        linking.stream_register(spark, source, f"{path}/layer", f"{path}/checkpoint", 8).awaitTermination()
    found = linking.Layer(spark, f"{path}/layer", 8).registered.read(linking.REGISTERED)
    return found.select("doc_id", "sha256", F.col("filename").cast("long").cast("string").alias("filename"))
