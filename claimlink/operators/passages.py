"""Known passages in documents."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short passages that are looked for in one reading of the documents.
SHORT_AT_ONCE = 20_000


def locate_passages(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id, start): each passage (item_id, text) that stands verbatim in a document (doc_id, text), with its first offset.

    Wherever a passage of four words or more stands, its second and third word stand between spaces, so their hash is the key of an
    equi-join with the documents' word pairs, and only documents that share it meet the passage's text. Shorter passages have no such
    key, as they may stand within words: blocks of them are looked for in one reading of the documents each (_locate_short). Null
    passages and documents have no row, an empty passage stands at the beginning of every document.
    """
    pair = lambda words, i: F.xxhash64(F.get(words, i), F.get(words, i + 1))
    words = F.split("text", " ", -1)
    given = passages.where("text IS NOT NULL").withColumn("w", words)
    keyed = given.where(F.size("w") >= 4).select("item_id", F.col("text").alias("passage"), pair(F.col("w"), F.lit(1)).alias("key"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: pair(F.col("w"), i)))
    in_docs = documents.where("text IS NOT NULL").select("doc_id", words.alias("w")).select("doc_id", F.explode(pairs).alias("key"))
    met = in_docs.join(keyed, "key").select("doc_id", "item_id", "passage")
    found = met.join(documents, "doc_id").select("item_id", "doc_id", (F.instr("text", F.col("passage")) - 1).cast("long").alias("start"))
    found = found.where("start >= 0").distinct()
    short = given.where(F.size("w") < 4).select("item_id", "text")
    blocks = -(-short.count() // SHORT_AT_ONCE)
    for n in range(blocks):
        found = found.unionByName(_locate_short(short.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n), documents))
    return found


def _locate_short(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """The same for so few passages that each task can have an automaton of them all, which reads a text once."""
    items: dict[str, list] = {}
    for item, text in passages.collect():
        items.setdefault(text, []).append(item)
    kinds = [(c, df.schema[c].dataType.simpleString()) for df, c in ((passages, "item_id"), (documents, "doc_id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for text in items:
            if text:
                automaton.add_word(text, text)
        automaton.make_automaton()
        for batch in batches:
            docs, out = batch.column(0), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                first: dict[str, int] = {"": 0} if "" in items else {}
                if len(automaton):
                    for end, passage in automaton.iter(text):
                        first.setdefault(passage, end + 1 - len(passage))
                out += [(item, k, start) for passage, start in first.items() for item in items[passage]]
            names, rows, starts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, item_type), docs.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64())], names=["item_id", "doc_id", "start"])

    item_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kinds[0][1]]
    return documents.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds) + ", start long").distinct()
