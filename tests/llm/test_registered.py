"""Registered queries on whole tables against brute force, and on tables that are empty, have very long texts or repeat rows."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from claimlink.llm import queries

OPS = queries.queries()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chats(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn, role or "", text or ""))
    turns[-7] = [(True, 0, "user", r"\### Assistant: </turn> ok"), (True, 1, "assistant", r"\### Assistant: </turn> ok")]
    out = {}
    for conv, of in turns.items():
        of.sort()
        loss = "".join(x[3] for x in of if x[2] == "assistant")
        out[conv] = (len(of), sha("".join(f"{x[2]}\n{x[3]}\n" for x in of)), len(loss), sha(loss))
    return out


def read_back(rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_op9_digests_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = OPS["op9_chat_formatting"](spark, sf_dir).collect()
    assert read_back(got) == chats(rows) and len(got) == len(chats(rows)) and all(r.formatted_chars > r.loss_chars for r in got)


def test_op9_empty_table_and_very_long_text(spark, tmp_path):
    kinds = "conv_id long, turn long, role string, text string"
    long = ("### a: </turn>\n\\ <|image|> é😀" * 60_000, "</turn>" * 9)
    rows = [(1, 0, "user", long[0]), (1, 1, "assistant", long[1]), (1, 2, None, None), (None, None, "assistant", "x")]
    for name, of in (("a", rows), ("b", [])):
        spark.createDataFrame(of, kinds).withColumn("turns", F.lit(1)).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        assert read_back(OPS["op9_chat_formatting"](spark, f"{tmp_path}/{name}").collect()) == chats(of)


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}")]
    return host, path, max(fits, key=len, default=None)


def test_op5_parts_and_rules_on_the_table(spark, sf_dir):
    urls = dict(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect())
    got = OPS["op5_url_filters"](spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule) == judged(urls[r.page_id])
        assert r.verdict == RULES[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert len({r.verdict for r in got}) == 2


def test_op5_empty_table_and_repeated_rows(spark, tmp_path):
    kinds, odd = "page_id long, url string", [(1, "http://A.Example.NET/en/x?y"), (1, "http://A.Example.NET/en/x?y"), (2, None), (3, "no scheme"), (None, "https://fr.org/fr/"), (4, "x://" + "a" * 3_000 + "/b")]
    for name, rows in (("a", odd), ("b", [])):
        spark.createDataFrame(rows, kinds).withColumn("html", F.lit("")).withColumn("host", F.lit(1)).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = OPS["op5_url_filters"](spark, f"{tmp_path}/{name}").collect()
        assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in got) == collections.Counter((i, *judged(u)) for i, u in rows)


@pytest.fixture(scope="module")
def long_tables(spark, tmp_path_factory):
    """Two near copies of 0.6 MB, a text of one letter, words of 0.2 and 0.3 MB, repeated rows and rows without text; labels for some."""
    base = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(80_000))
    rows = [(1, base), (2, base.replace("w7919 ", "x ")), (3, "a" * 200_000), (4, "b" * 300_000), (5, None), (6, ""), (7, "short text."), (7, "short text."), (None, "no id")]
    folder = str(tmp_path_factory.mktemp("long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.withColumns({"node": F.lit(1), "size": F.lit("x"), "score": F.lit(2)}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0), (4, 0), (7, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_very_long_texts_are_linked(spark, long_tables):
    got = {(r.doc_id, r.component_id) for r in OPS["op1_ngram_jaccard_join"](spark, long_tables[0]).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (None, None)}


def test_very_long_texts_have_statistics(spark, long_tables):
    folder, rows = long_tables
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars) for r in OPS["op7_quality_rules"](spark, folder).collect())
    words = [(i, [w.decode() for w in WORD.findall((t or "").encode())]) for i, t in rows]
    assert got == collections.Counter((i, len(w), sum(map(len, w))) for i, w in words)


def test_very_long_texts_are_scored(spark, long_tables):
    got = OPS["op4_quality_classifier"](spark, long_tables[0]).collect()
    assert len(got) == len(long_tables[1]) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_very_long_texts_lose_their_repeats(spark, long_tables):
    got = {r.doc_id: r for r in OPS["op8_suffix_array_dedup"](spark, long_tables[0]).collect()}
    assert (got[3].n_removed, got[4].n_removed, got[1].n_removed) == (199_999, 299_999, 0)
    assert got[2].n_removed > got[2].n_bytes - 400 and got[3].kept_sha256 == sha("a")
