"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlink.llm import factor_quality, jaccard_join, packing, quality_rules, repeats
from claimlink.llm.shared import discard, materialise

#: Words that a document must have to stay, whatever the rules say. Short texts are left to the votes and to the classifier.
MIN_WORDS = 1


def filter_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules reject go. Short clean documents stay: only a text without words goes unasked."""
    return quality_rules.keep_good(docs, min_words=MIN_WORDS)


def filter_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is learnt from the labelled ones among those that are left."""
    return factor_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more) the smallest doc_id stays."""
    return jaccard_join.first_of_each_group(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that have occurred before go; n_chars is that of the text that is left."""
    names = docs.columns
    left = repeats.mark_repeats(docs, cut_out=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens. A document with nothing left has no piece."""
    return packing.pack(docs.where(F.length("text") > 0))


STAGES = [
    ("quality_rules", filter_by_rules),
    ("quality_classifier", filter_by_classifier),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: No stage but the last decides by rules that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
