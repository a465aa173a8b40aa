"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is dealt, by hash, into the blocks of a parity sketch: each shingle flips one bit, so two
sketches differ in at most as many bits as the sets differ in shingles. Sets of a size band that are similar enough differ in at
most d shingles, hence agree in one of more than d blocks: that block's content is the key of an equi-join. Every pair that
shares a key is compared with the exact sets, or cleared by the Hamming distance of its sketches, or already in one component.

Which pairs are looked at: documents with equal sets are one node. Each key's smallest node leads it and is compared with all
others of the key, which is linear in the key's size; the leaders of hot keys come from an aggregate and a broadcast, so that no
task reads a hot key. Where that leaves the nodes of a leader's keys in several components, the pairs across components are compared by their
sketches, in blocks within tasks, and those that the bound doesn't clear by their sets. No link is lost.

Keys are most of what is shuffled. They are dealt by range into KEY_PARTS, which meet one part after the other, so that the disk holds one
part's shuffle at a time; then the keys' table is deleted. What finds pairs is the same as with all keys at once.

Sketches come with the keys, from the one pass that reads all texts; only texts in pairs that aren't cleared are fetched, and
their exact sets are made where both meet. Joins of pairs have a merge hint: with the nodes' number, both sides outgrow any broadcast.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlink.llm.graph import components
from claimlink.llm.shared import U64, arrow_batches, discard, materialise, mix, shingles, steps, text_rows, utf8, words

#: Words of 64 bits in the sketch that is kept for comparing nodes; nodes of a key that are compared at once in a task.
SKETCH_WORDS, MEMBERS = 32, 256
#: Columns of the parts of keys that are shuffled one after the other, by the keys' first bits.
KEY_PARTS = ("keys0", "keys1", "keys2", "keys3")
#: Salts of a leader's members.
SALTS = 32
#: Keys with about so many rows or more are hot. A bounded sketch finds them, so there are at most MOST_HOT.
HOT, MOST_HOT = 20_000, 1_000
#: Nodes that a task remembers, so that it gives out the keys of copies once.
REMEMBERED = 1_000_000


class Bands:
    """Size bands and their blocks for a similarity of percent / 100. A pair belongs to the band of its smaller set."""

    def __init__(self, percent: int, largest: int = 1 << 40) -> None:
        self.percent, self.low, self.apart, self.blocks = percent, [1], [], []
        while self.low[-1] < largest:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 4 // 3)))
        for low, high in zip(self.low, self.low[1:], strict=False):
            small = high - 1
            d = (100 - percent) * (small + small * 100 // percent) // (100 + percent)
            self.apart.append(d)
            slack = 0
            if d:
                empty = (d + 1) * np.exp(-low / (d + 1))
                slack = int(min(d, np.ceil(empty + 3 * empty**0.5)))
            self.blocks.append(d + 1 + slack)

    def of(self, n: int) -> range:
        """Bands in which a set of n can be the smaller or the larger one."""
        return range(bisect_right(self.low, -(-n * self.percent // 100)) - 1, bisect_right(self.low, n))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Join keys of one set: a hash of band, block and the block's content, the exclusive or of its shingles' hashes.

        Empty blocks are left out: at most d blocks are touched, so a set with more than d filled blocks shares a filled one with
        any that it links to. Sets with fewer need to meet only each other beyond that, and do by their contents: two sets that
        are similar enough share one of the first n - t * n + 1 of their hashes in ascending order.
        """
        out, sparse = [], False
        for band in self.of(len(hashes)):
            n = self.blocks[band]
            block = ((hashes >> U64(20)) % U64(n)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            at, first = np.unique(block[order], return_index=True)
            content = np.bitwise_xor.reduceat(hashes[order], first)
            out.append(mix(content ^ mix(U64(band << 40) + at.astype(U64) + U64(1))))
            sparse |= len(at) <= self.apart[band]
        if sparse:
            least = -(-len(hashes) * self.percent // 100)
            out.append(mix(np.sort(hashes)[: len(hashes) - least + 1] + U64(3)))
        return np.concatenate(out)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text, A-Z lower-cased."""
    for a, b in steps(texts):
        hashes, _, _, first = words(t.lower() for t in texts[a:b])
        for i, j in zip(first, first[1:], strict=False):
            yield np.unique(shingles(hashes[i:j], n))


def set_hash(hashes: np.ndarray) -> int:
    total = mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True, dtype=U64)
    return int(mix(total + U64(len(hashes))).view(np.int64)[0])


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes >> U64(53)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def digests(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (the set's hash; null if it is empty), keys (KEY_PARTS) and sketch, which are null for copies that the task
    has met, and unnamed, a hash of the text where the doc_id is null."""
    bands = Bands(percent)
    parts = len(KEY_PARTS)
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in arrow_batches(batches):
            sizes, nodes, sketches = [], [], []
            keys: list[list[np.ndarray | None]] = [[] for _ in KEY_PARTS]
            for found in shingle_sets(utf8(batch.column(1)), n):
                node = set_hash(found) if len(found) else None
                sizes.append(len(found))
                nodes.append(node)
                new = node is not None and node not in met
                own = np.sort(bands.keys(found)) if new else None
                for part, x in zip(keys, np.split(own.view(np.int64), np.searchsorted(own, bounds)) if new else [None] * parts, strict=True):
                    part.append(x)
                sketches.append(sketch_of(found) if new else None)
                if node is not None and len(met) < REMEMBERED:
                    met.add(node)
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (*keys, sketches))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *lists, batch.column(2)], names=["doc_id", "n_shingles", "node", *KEY_PARTS, "sketch", "unnamed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("unnamed")
    return text_rows(docs).select("doc_id", "text", unnamed).mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, {', '.join(f'{c} array<long>' for c in KEY_PARTS)}, sketch array<long>, unnamed long")


def owners(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, and of the documents that have its set the smallest doc_id, or the hash of a text where all of them have a null doc_id,
    for each node in the pairs (a, b); rows are as digests gives them."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return rows.where("node IS NOT NULL").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("unnamed").alias("unnamed"))


def texts_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node and text of the wanted (node, doc_id, unnamed), one row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            nodes = batch.column(0).to_pylist()
            right = [len(x) > 0 and set_hash(x) == node for node, x in zip(nodes, shingle_sets(utf8(batch.column(1)), n), strict=True)]
            yield batch.filter(pa.array(right, pa.bool_()))  # the others are further texts of the same doc_id

    named = docs.select("doc_id", "text").join(wanted.where("doc_id IS NOT NULL").select("node", "doc_id"), "doc_id")
    unnamed = docs.where("doc_id IS NULL").select(F.xxhash64("text").alias("unnamed"), "text").join(wanted.where("doc_id IS NULL").select("node", "unnamed"), "unnamed")
    return named.select("node", "text").unionByName(unnamed.select("node", "text")).mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def hot_keys(keyed: DataFrame) -> list[int]:
    """The keys of keyed (key) with about HOT rows or more."""
    top = keyed.agg(F.call_function("approx_top_k", "key", F.lit(MOST_HOT), F.lit(10 * MOST_HOT)).alias("t")).select(F.explode("t").alias("t")).where(F.col("t.count") >= HOT)
    return [r["key"] for r in top.select(F.col("t.item").alias("key")).collect()]  # at most MOST_HOT


def stars(keyed: DataFrame, hot: list[int]) -> DataFrame:
    """(a, b): for each key of keyed (node, key; read more than once if there are hot keys) its smallest node, and each other node."""
    first = F.first("node").over(Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not hot:
        return keyed.withColumn("leader", first).where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    table = F.broadcast(keyed.sparkSession.createDataFrame([(k,) for k in hot], "key long"))
    among = keyed.join(table, "key")
    leaders = F.broadcast(among.groupBy("key").agg(F.min("node").alias("leader")))
    led = keyed.join(table, "key", "left_anti").withColumn("leader", first).select("leader", "node").union(among.join(leaders, "key").select("leader", "node"))
    return led.where("node <> leader").toDF("a", "b")


def not_cleared(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sketches (node, n, sketch) differ in no more bits than similar sets' do in shingles."""
    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    most = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.abs(F.col("na") - F.col("nb")) <= most)
    return met.where(apart <= most).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets are similar enough.

    A task reads, for each a, its text and then those of its partners, one after the other; the partners of an a are salted
    where there are more than MEMBERS of them. So a row has one text, and sets, which take several times the room of their texts, are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, U64)
        for batch in arrow_batches(batches):
            found: list[list[int]] = [[], []]
            for a, salt, b, x in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), shingle_sets(utf8(batch.column("text")), n), strict=True):
                if b is None:
                    key, own = (a, salt), x
                elif key == (a, salt):
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    salted = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    own = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a").hint("merge"), "a")
    partners = salted.join(texts.withColumnRenamed("node", "b").hint("merge"), "b")
    rows = own.select("a", "salt", F.lit(None).cast("long").alias("b"), "text").unionByName(partners.select("a", "salt", "b", "text"))
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def open_pairs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components among the members (leader, node, c) of each leader that the sketches (node, n, sketch) don't clear.

    A leader's members are dealt into chunks, and each pair of chunks is one group: no group holds more than 2 * MEMBERS rows or so.
    Two nodes whose smallest leader is the same meet with that one only.
    """
    home = members.groupBy("node").agg(F.min("leader").alias("home"))
    split = members.groupBy("leader").agg(F.count("*").alias("m"), F.min("c").alias("l"), F.max("c").alias("h")).where("m > 2 AND l <> h")
    split = split.select("leader", F.ceil(F.col("m") / MEMBERS).cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(split, ["leader", "salt"])
    dealt = dealt.join(home, "node").join(sketches, "node").withColumn("x", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda y: F.struct(F.least("x", y).alias("i"), F.greatest("x", y).alias("j")))
    spread = dealt.withColumn("p", F.explode(others)).select("leader", "home", "p.*", "x", "node", "c", "n", "sketch")

    def run(group: pa.Table) -> pa.Table:
        x, i, node, c, n, home, leader = (group.column(k).to_numpy() for k in ("x", "i", "node", "c", "n", "home", "leader"))
        sketch = group.column("sketch").combine_chunks().flatten().to_numpy().view(U64).reshape(-1, SKETCH_WORDS)
        left, right = np.flatnonzero(x == i), np.flatnonzero(x == group.column("j").to_numpy())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in left:
            limit = (100 - percent) * (n[k] + n[right]) // (100 + percent)
            here = (home[right] != home[k]) | (home[k] == leader[k])
            near = right[here & (c[right] != c[k]) & (np.abs(n[right] - n[k]) <= limit)]
            if len(near):
                apart = np.bitwise_count(sketch[near] ^ sketch[k]).sum(1)
                near = near[apart <= (100 - percent) * (n[k] + n[near]) // (100 + percent)]
                a.append(np.minimum(node[near], node[k]))
                b.append(np.maximum(node[near], node[k]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return spread.groupBy("leader", "i", "j").applyInArrow(run, "a long, b long").distinct()


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row of docs (doc_id, text).

    Documents link when their sets of n-word shingles have a Jaccard similarity of percent / 100 or more. Words are split at
    ASCII white space; shorter texts have their whole sequence as one shingle. Null, empty and blank texts have no shingles,
    link with nothing and are their own component. Rows with a repeated doc_id are linked each by its own text, and so are rows with
    a null doc_id; where all of a component have one, its component_id is null.
    """
    docs = docs.select("doc_id", "text")
    digested = materialise(digests(docs, n, percent))
    rows = materialise(digested.select("doc_id", "n_shingles", "node", "unnamed"))
    sketches = materialise(digested.where("sketch IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    hot = hot_keys(digested.select(F.explode(F.concat(*KEY_PARTS)).alias("key")))
    met = [materialise(stars(digested.select("node", F.explode(part).alias("key")), hot).distinct()) for part in KEY_PARTS]
    discard(digested)
    pairs = materialise(reduce(DataFrame.union, met).distinct())
    discard(*met)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"))

    near = materialise(not_cleared(pairs, sketches, percent))
    wanted = materialise(owners(rows, near))
    texts = materialise(texts_of(docs, wanted.hint("merge"), n))
    links = materialise(verified(near, texts, n, percent))
    labels = components(links)
    members = pairs.select(F.col("a").alias("leader"), F.explode(F.array("a", "b")).alias("node")).distinct()
    members = members.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).select("leader", "node", "c")
    left = materialise(open_pairs(members, sketches, percent).join(pairs, ["a", "b"], "left_anti"))
    spent = [rows, pairs, sketches, near, wanted, texts, links, left]
    if not left.isEmpty():
        others = materialise(owners(rows, left).join(texts.select("node"), "node", "left_anti"))
        rest = materialise(texts_of(docs, others, n))  # most of them are known; Spark broadcasts the others if they are few
        more = materialise(verified(left, texts.union(rest), n, percent))
        labels = components(links.union(more))
        spent += [others, rest, more]

    named = nodes.join(labels, "node", "left").select("node", "id", F.coalesce("component", "node").alias("c"))
    smallest = named.groupBy("c").agg(F.min("id").alias("component_id"))
    of = named.join(smallest, "c").select("node", "component_id")
    found = materialise(rows.select("doc_id", "n_shingles", "node").join(of, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    discard(*spent)
    return found


def first_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; one of rows that repeat both doc_id and text.

    Texts move once, to meet the ids that stay, in one way at every size. Only rows with an id that is null or there more than once
    are compared with each other.
    """
    linked = link_documents(docs, n, percent)
    ids = linked.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"))
    ids = materialise(ids.where("first"))
    discard(linked)
    kept = docs.join(ids.where("rows = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    often = ids.where("rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_kept"))
    if often.isEmpty():
        return kept
    rows = docs.join(often, docs["doc_id"].eqNullSafe(often["_kept"]), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    return kept.unionByName(rows.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=4, percent=85)
