"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how reliable each is, and the
posterior probability of good quality replaces a filter that all rules must pass.

A text is good, noisy or repetitive. Each of these classes has a share, and for each rule a chance that a vote of it is a bad one;
both come from the votes of all texts. An abstention says nothing. What the rules were meant for is only a prior of PSEUDO votes,
which vanishes beside the data: a rule whose bad votes don't go together with those of its kind is found to be unreliable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlink.llm.shared import U64, arrow_batches, materialise, mix, shingles, steps, text_rows, utf8, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_lines", "n_pipes", "n_stutters", "n_odd_words")
_WORD_LINE = re.compile(rb"[^\x20\x09-\x0D]")


def _table(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_SYMBOL, _PIPE, _UPPER, _LOWER = _table(*b"#*$%&|<>"), _table(*b"|"), _table(*range(65, 91)), _table(*range(97, 123))
_LETTER, _MARK = _UPPER | _LOWER | _table(*range(128, 256)), _table(*b".,;:?!'\")")

#: Rules: name -> (share that it looks at, bad from, good up to, what it is about). Between the two a rule abstains, and so it does without words.
RULES = {
    "symbols": ("symbol_share", 0.04, 0.01, "noisy"),
    "upper_case": ("upper_share", 0.20, 0.05, "noisy"),
    "pipes": ("pipe_share", 0.08, 0.01, "noisy"),
    "odd_words": ("odd_share", 0.50, 0.20, "noisy"),
    "long_words": ("mean_word", 16.0, 12.0, "noisy"),
    "short_words": ("short_word", 0.5, 0.0, "noisy"),
    "repeated_words": ("repeat_share", 0.50, 0.10, "repetitive"),
    "stutters": ("stutter_share", 0.20, 0.05, "repetitive"),
    "repeated_lines": ("dup_line_share", 0.50, 0.10, "repetitive"),
}
CLASSES = ("good", "noisy", "repetitive")
#: Chance that a vote is a bad one before any data, in a text of the rule's own class and in others; votes that this prior counts as.
OWN, OTHER, PSEUDO = 0.5, 0.02, 20.0


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags are set from each of first up to the next."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def text_stats(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """STATS of each text, and the texts' word hashes with the first word of each text and the total."""
    hashes, start, end, first = words(texts)
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    before = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    caps, small, letters, chars = map(before, (_UPPER[buffer], _LOWER[buffer], _LETTER[buffer], (buffer & 0xC0) != 0x80))
    n_caps, n_small, n_letters = caps[end] - caps[start], small[end] - small[start], letters[end] - letters[start]
    upper = (n_caps >= 2) & (n_small == 0)
    plain = (n_letters + (_MARK[buffer[end - 1]] if len(end) else 0) >= end - start) & (n_caps <= 1)
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    repeated = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        own = np.flatnonzero(text[2:] == text[:-2])
        windows = mix(shingles(hashes, 3)[own] ^ mix(text[own].astype(U64) + U64(1)))
        order = np.argsort(windows)
        same = np.diff(windows[order]) == 0
        at = own[order[np.append(same, False) | np.append(False, same)]] if len(own) else own
        for i in range(3):
            repeated[at + i] = True
    lines = [[x for x in t.split(b"\n") if _WORD_LINE.search(x)] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    dup = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    word_chars = _sums(chars[end] - chars[start], first)
    columns = (np.diff(first), word_chars, _sums(_SYMBOL[buffer], offsets), dup, _sums(repeated, first), _sums(upper, first), n_lines, _sums(_PIPE[buffer], offsets), _sums(stutter, first), _sums(~plain, first))
    return np.stack(columns, 1).astype(np.int64), hashes, first


def votes(stats: np.ndarray) -> np.ndarray:
    """-1 bad, 0 abstains, 1 good, for each row of STATS and each rule."""
    n_words, chars, symbols, dup, repeat, upper, lines, pipes, stutters, odd = stats.T.astype(float)
    n = np.maximum(n_words, 1)
    shares = {
        "symbol_share": symbols / np.maximum(chars, 1),
        "upper_share": upper / n,
        "pipe_share": pipes / n,
        "odd_share": odd / n,
        "mean_word": chars / n,
        "short_word": (chars / n < 2.2).astype(float),
        "repeat_share": repeat / n,
        "stutter_share": stutters / n,
        "dup_line_share": np.where(lines >= 4, dup / np.maximum(lines, 1), 0.0),
    }
    cast = [np.where(shares[share] >= bad, -1, np.where(shares[share] <= good, 1, 0)) for share, bad, good, _ in RULES.values()]
    return np.where(n_words[:, None] > 0, np.stack(cast, 1), 0)


def patterns_of(cast: np.ndarray) -> np.ndarray:
    """One number for each row of votes; there are 3 ** rules of them."""
    return ((cast + 1) * 3 ** np.arange(cast.shape[1])).sum(1)


def votes_of(patterns: np.ndarray, rules: int = len(RULES)) -> np.ndarray:
    """The votes that patterns_of has numbered."""
    return patterns[:, None] // 3 ** np.arange(rules) % 3 - 1


def add_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, STATS and pattern (the votes), one row for each row of docs; null and empty texts have zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            texts = utf8(batch.column(0))
            table = np.concatenate([np.zeros((0, len(STATS)), np.int64), *(text_stats(texts[a:b])[0] for a, b in steps(texts))])
            columns = [*batch.columns[1:], *(pa.array(table[:, k]) for k in range(len(STATS))), pa.array(patterns_of(votes(table)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *STATS, "pattern"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in (*STATS, "pattern"))])
    return text_rows(docs).select(F.col(text).alias("_t"), *keep).mapInArrow(run, schema)


def estimate(cast: np.ndarray, counts: np.ndarray, classes: tuple[str, ...] | None = None, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over distinct vote patterns (rows of -1, 0, 1) with their counts.

    classes: the class that each rule is about, by default that of RULES. Returns the posterior probability of good for each
    pattern, the chances [class, rule] that a vote is bad, and the classes' shares.
    """
    about = np.array(classes or [c for *_, c in RULES.values()])
    prior = np.where(about == np.array(CLASSES)[:, None], OWN, OTHER)
    bad, good = (cast == -1).astype(float), (cast == 1).astype(float)
    chance, share, before = prior, np.array([0.8, 0.1, 0.1]), None
    for _ in range(rounds):
        log = np.log(share)[:, None] + np.log(chance) @ bad.T + np.log1p(-chance) @ good.T
        posterior = np.exp(log - log.max(0))
        posterior /= posterior.sum(0)
        if before is not None and np.abs(posterior - before).max() < 1e-9:
            break
        before, weight = posterior, counts * posterior
        share = (weight.sum(1) + 1) / (counts.sum() + len(CLASSES))
        seen_bad, seen_good = weight @ bad + PSEUDO * prior, weight @ good + PSEUDO * (1 - prior)
        chance = seen_bad / (seen_bad + seen_good)
    return posterior[0], chance, share


def posteriors(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Patterns in ascending order and their p_good, from the votes of all rows of stats (pattern)."""
    found = sorted(map(tuple, stats.groupBy("pattern").count().collect()))  # at most 3 ** rules, 19,683
    patterns, counts = np.array(found, np.int64).reshape(-1, 2).T
    return (patterns, estimate(votes_of(patterns), counts.astype(float))[0]) if len(patterns) else (patterns, np.zeros(0))


def judge(stats: DataFrame, threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """stats (with STATS and pattern, read twice) with p_good, base_failed and kept. A text without words fails the base."""
    patterns, p_good = posteriors(stats)
    table = stats.sparkSession.createDataFrame(pa.table({"pattern": patterns, "p_good": p_good}))  # bounded, hence broadcast
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~failed & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """The rows of docs (text and any other columns) that the rules keep. The statistics are computed twice, for the vote
    patterns of all rows and for the verdicts, as that is less work than writing or shuffling the texts."""
    patterns, p_good = posteriors(add_stats(docs.select("text"), keep=()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            texts = utf8(batch.column(at))
            kept = [np.zeros(0, bool)]
            for a, b in steps(texts):
                table = text_stats(texts[a:b])[0]
                failed = (table[:, 0] < min_words) | (100 * table[:, STATS.index("n_repeat_words")] > 50 * table[:, 0])
                kept.append(~failed & (p_good[np.searchsorted(patterns, patterns_of(votes(table)))] >= threshold))
            yield batch.filter(pa.array(np.concatenate(kept)))

    own = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])  # names may clash
    return text_rows(docs).toDF(*own.names).mapInArrow(run, own).toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
    return judge(materialise(add_stats(docs))).select(*columns)
