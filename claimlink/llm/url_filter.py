"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame and SQL functions; the model is Spark's own logistic regression, fitted on a small labelled URL table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule): host, then a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The small labelled URL table: 1 is to be blocked.
LABELLED = (
    (1, "http://cheap-pills.example.com/en/12"), (1, "https://www.cheap-pills.example.org/fr/7"), (1, "https://buy-cheap-meds.example.com/en/offer"),
    (1, "http://casino-win.example.com/en/88"), (1, "https://m.casino-win.example.org/es/3"), (1, "http://casino-bonus.example.com/de/slots"),
    (1, "https://free-bets.example.org/en/5"), (1, "http://www.free-bets.example.com/fr/91"), (1, "http://sport-bets.example.org/en/odds"),
    (1, "https://adult-x.example.com/en/41"), (1, "http://blog.adult-x.example.org/es/6"), (1, "http://adult-cams.example.com/en/live"),
    (1, "http://spam-farm.example.org/en/728"), (1, "https://www.spam-farm.example.com/de/15"), (1, "http://link-farm.example.org/fr/2"),
    (1, "https://ads-track.example.com/en/33"), (1, "http://m.ads-track.example.org/fr/8"), (1, "http://click-track.example.com/en/ads"),
    (1, "http://free-win-bonus.example.org/en/1"), (1, "https://cheap-pills-store.example.org/en/buy"), (1, "http://xxx-adult.example.org/fr/4"),
    (1, "http://free-casino.example.com/es/77"), (1, "http://win-free-bets.example.com/en/60"), (1, "https://track-ads.example.org/en/9"),
    (0, "http://ththre.example.com/fr/825"), (0, "https://m.ththth.example.org/en/25"), (0, "https://thther.example.org/en/685"),
    (0, "http://therha.example.com/en/676"), (0, "https://therin.example.org/en/770"), (0, "https://blog.tiontion.example.com/en/853/"),
    (0, "http://blog.ththan.example.org/en/960"), (0, "https://m.therou.example.com/en/474.html"), (0, "https://ththin.example.com/en/671"),
    (0, "https://blog.tionsh.example.org/es/533/"), (0, "https://www.ththen.example.com/en/148.html"), (0, "https://blog.thertion.example.org/es/978"),
    (0, "https://ththble.example.org/es/797"), (0, "https://blog.ththly.example.org/en/777"), (0, "https://www.ththwh.example.org/en/471"),
    (0, "https://blog.thernd.example.com/de/612"), (0, "http://thering.example.com/en/328/"), (0, "https://www.therti.example.org/en/334/"),
    (0, "https://news.example.com/en/2024"), (0, "http://www.library.example.org/fr/books"), (0, "https://blog.garden.example.com/es/plants"),
    (0, "https://museum.example.org/de/heute"), (0, "http://m.weather.example.com/en/today"), (0, "https://www.recipes.example.org/fr/soupe"),
    (0, "https://university.example.org/en/research"), (0, "http://history.example.com/es/siglo"), (0, "https://docs.software.example.org/en/install"),
    (0, "http://tionble.example.com/en/11"), (0, "https://tionhe.example.org/fr/19"), (0, "http://www.tioner.example.com/de/24"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without `://` and for null."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null. A rule's host fits itself and all its subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        of, slash, prefix = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def hashed_grams(host: Column, path: Column, sizes=(3, 4), dim: int = 4096) -> Column:
    """Bucket numbers of all character n-grams of `^host$` and of `/path`, each kept apart by its part's mark."""

    def grams(text: Column, mark: str, n: int) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(dim)).cast("int"))
        return F.when(F.length(text) >= n, windows).otherwise(F.array().cast("array<int>"))

    parts = ((F.concat(F.lit("^"), host, F.lit("$")), "h"), (path, "p"))
    return F.concat(*(grams(text, mark, n) for text, mark in parts for n in sizes))


def labelled_urls(spark: SparkSession, rows=LABELLED) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({y}, '{url}')" for y, url in rows) + " AS t(label, url)")


def fit(labelled: DataFrame, dim: int = 4096, reg: float = 0.002) -> tuple[list[float], float]:
    """Weights and intercept from a labelled URL table (label, url); the table is small by its contract."""
    host, path = host_and_path(F.col("url"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(F.col("g"), lambda g: g == i)).cast("double"))
    rows = labelled.select(F.col("label").cast("double").alias("label"), hashed_grams(host, path, dim=dim).alias("g"))
    rows = rows.select("label", array_to_vector(counts).alias("features")).coalesce(1)
    model = LogisticRegression(regParam=reg, maxIter=60, standardization=False).fit(rows)
    return [float(x) for x in model.coefficients], float(model.intercept)


def judge_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score and verdict (allow or block) in place of columns of these names.

    The verdict is that of the longest rule that fits, else block where the model's score reaches the threshold. A null or
    malformed url has an empty host and path, fits no rule and is judged by the intercept alone.
    """
    weights, intercept = fit(labelled)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # a constant, folded once
    host, path = host_and_path(F.col(url))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, decided = matching_rule(F.col("host"), F.col("path"), rules)
    logit = F.aggregate(hashed_grams(F.col("host"), F.col("path"), dim=len(weights)), F.lit(intercept), lambda acc, g: acc + F.get(table, g))
    scored = parts.withColumns({"rule": rule, "score": 1 / (1 + F.exp(-logit))})
    return scored.withColumn("verdict", F.coalesce(decided, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
