"""Conversation structure repair: the cheapest edits that turn a conversation's rows into turns by user and assistant in alternation.

The rows before which one stands and the role that came last make a node; keeping, changing, deleting a row and inserting one are
arcs that cost 0 to 3. As costs are small whole numbers, distances to the end come from Dial's bucket queue. From the start, the
smallest letter of an arc that is tight, that is on a shortest path, is taken again and again: the audit.

Conversations are cut into segments of a bounded number of rows, dealt by range, so that a conversation of any length is spread over
tasks. Where there is more than one segment, each gives the costs between its four entries and four exits; from these follow the
distances at the segments' ends, then each segment's walk from each entry, then the entries that are really met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlink.llm.shared import discard, materialise

#: Rows of a segment, at most.
SEGMENT = 2048
#: What came last: nothing, a system row, a user's or an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: The end may be reached with nothing or with an assistant's row.
DONE = [0, FAR, FAR, 0]
#: By initial: the states that it may follow, and the state it leads to.
AFTER = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: From each state the role of a row that is changed or inserted, and the state after it.
NEXT = {NOTHING: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
CHANGE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters of AFTER may stand next to each other like this.
LEGAL = ("su", "ua", "au")
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"


def distances(kinds: str, ends: list[int]) -> list[int]:
    """The cost from each node (4 * row + state) to the end, where leaving in a state costs what ends has for it.

    kinds: a letter for each row, `-` if it must be deleted, else its role's initial (x for others), in upper case if it is truncated.
    """
    n, start = len(kinds), min(ends)
    found = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(4)]
    for state, cost in enumerate(ends):
        if cost < FAR:
            while len(buckets) <= cost - start:
                buckets.append([])
            buckets[cost - start].append(4 * n + state)
    at = 0
    while at < len(buckets):
        for node in buckets[at]:  # arcs of no cost add to the bucket that is being read
            if found[node] <= at:
                continue
            found[node] = at
            while len(buckets) < at + 4:
                buckets.append([])
            row, state = divmod(node, 4)
            here = node - state
            if state == USER:
                buckets[at + INSERT] += [here + NOTHING, here + SYSTEM, here + ASSISTANT]
            elif state == ASSISTANT:
                buckets[at + INSERT].append(here + USER)
            if row:
                kind, before = kinds[row - 1], here - 4
                buckets[at + DELETE].append(before + state)
                if kind != "-":
                    initial = kind.lower()
                    extra = TRUNCATED if kind != initial else 0
                    if initial in AFTER and AFTER[initial][1] == state:
                        buckets[at + extra] += [before + p for p in AFTER[initial][0]]
                    if state == USER:
                        buckets[at + CHANGE + extra] += [before + NOTHING, before + SYSTEM, before + ASSISTANT]
                    elif state == ASSISTANT:
                        buckets[at + CHANGE + extra].append(before + USER)
        buckets[at] = []
        at += 1
    return [d + start if d < FAR else FAR for d in found]


def walk(kinds: str, found: list[int], ends: list[int], state: int) -> tuple[str, int]:
    """The ASCII-least letters of the edits on a cheapest way from a state, and the state at the end."""
    row, letters = 0, []
    while row < len(kinds) or found[4 * row + state] != ends[state]:
        left, here = found[4 * row + state], 4 * row
        kind = kinds[row] if row < len(kinds) else None
        initial = kind.lower() if kind else None
        extra = TRUNCATED if kind and kind != initial else 0
        after = NEXT[state][1]
        if kind and DELETE + found[here + 4 + state] == left:
            letter, row = "D", row + 1
        elif INSERT + found[here + after] == left:
            letter, state = "I", after
        elif initial in AFTER and state in AFTER[initial][0] and extra + found[here + 4 + AFTER[initial][1]] == left:
            letter, row, state = "K", row + 1, AFTER[initial][1]
        else:
            letter, row, state = "R", row + 1, after
        letters.append(letter)
    return "".join(letters), state


def replay(letters: str, kinds: str, state: int) -> Iterator[tuple[int | None, str | None]]:
    """(row or None, new role or None) of what the edits leave: a kept row has no new role, an inserted one no row."""
    row = 0
    for letter in letters:
        if letter == "I":
            role, state = NEXT[state]
            yield None, role
        elif letter == "K":
            yield row, None
            state = AFTER[kinds[row].lower()][1]
        elif letter == "R":
            role, state = NEXT[state]
            yield row, role
        row += letter != "I"


_NAMES = pa.struct([("role", pa.string()), ("h", pa.string())])
_SEGMENTS = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("kinds", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("names", pa.list_(_NAMES))])
SEGMENTS = "key string, part int, seg long, kinds string, first string, last string, illegal long, names array<struct<role:string,h:string>>"
WALKS = "key string, part int, seg long, entry int, leaves int, cost long, edits string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their conversations as segments."""
    part, seg, made = TaskContext.get().partitionId(), 0, []
    key, kinds, names, initials = None, [], [], []

    def close() -> None:
        nonlocal seg, kinds, names, initials
        pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        made.append({"key": key, "part": part, "seg": seg, "kinds": "".join(kinds), "first": initials[0], "last": initials[-1], "illegal": pairs, "names": names})
        seg, kinds, names, initials = seg + 1, [], [], []

    for batch in batches:
        for k, role, h, initial, kind, n in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "h", "initial", "kind", "n")), strict=True):
            if kinds and k != key:
                close()
            key = k
            for i in range(n):  # equal rows: all but the first must go
                kinds.append("-" if i else kind)
                names.append({"role": None, "h": None} if kinds[-1] == "-" else {"role": role, "h": h})
                initials.append(initial)
                if len(kinds) == SEGMENT:
                    close()
                    if len(made) == 64:
                        yield from _batches(made, _SEGMENTS)
                        made = []
        yield from _batches(made, _SEGMENTS)
        made = []
    if kinds:
        close()
    yield from _batches(made, _SEGMENTS)


def _batches(rows: list[dict], schema: pa.Schema) -> list[pa.RecordBatch]:
    return pa.Table.from_pylist(rows, schema).combine_chunks().to_batches()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the costs from every entry to every exit, row by row."""
    for batch in batches:
        costs = []
        for kinds in batch.column("kinds").to_pylist():
            to = [distances(kinds, [0 if q == out else FAR for q in range(4)])[:4] for out in range(4)]
            costs.append([to[out][entry] for entry in range(4) for out in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("seg"), pa.array(costs, pa.list_(pa.int64()))], names=["key", "part", "seg", "costs"])


def _ends(table: pa.Table) -> pa.Table:
    """A conversation's segments with the costs to its end from each state in which they may be left."""
    table = table.sort_by([("part", "ascending"), ("seg", "ascending")])
    ends, out = DONE, []
    for costs in reversed(table.column("costs").to_pylist()):
        out.append(ends)
        ends = [min(costs[4 * entry + leaves] + ends[leaves] for leaves in range(4)) for entry in range(4)]
    return table.select(["part", "seg"]).append_column("ends", pa.array(out[::-1], pa.list_(pa.int64())))


def _entries(table: pa.Table) -> pa.Table:
    """A conversation's segments with the state in which they are entered."""
    table = table.sort_by([("part", "ascending"), ("seg", "ascending"), ("entry", "ascending")])
    leaves, state, out = table.column("leaves").to_pylist(), NOTHING, []
    for at in range(0, len(leaves), 4):
        out += [state == entry for entry in range(4)]
        state = leaves[at + state]
    return table.select(["part", "seg", "entry"]).filter(pa.array(out, pa.bool_()))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk through each segment from each of its entries; ends are those of the conversation where there are none."""
    for batch in batches:
        made = []
        for key, part, seg, kinds, ends in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "seg", "kinds", "ends")), strict=True):
            entries = range(4) if ends else (NOTHING,)
            ends = ends or DONE
            found = distances(kinds, ends)
            for entry in entries:
                edits, leaves = walk(kinds, found, ends, entry)
                made.append({"key": key, "part": part, "seg": seg, "entry": entry, "leaves": leaves, "cost": found[entry] - ends[leaves], "edits": edits})
        yield from _batches(made, pa.schema([("key", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("entry", pa.int32()), ("leaves", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


_LEFT = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("pos", pa.int32()), ("role", pa.string()), ("h", pa.string()), ("new_role", pa.string())])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of segments: their rows by role and text, and inserted ones."""
    for batch in batches:
        made = []
        for key, part, seg, kinds, names, edits, entry in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "seg", "kinds", "names", "edits", "entry")), strict=True):
            for pos, (row, role) in enumerate(replay(edits, kinds, entry)):
                old = names[row] if row is not None else {"role": None, "h": None}
                made.append({"key": key, "part": part, "seg": seg, "pos": pos, "role": old["role"], "h": old["h"], "new_role": role or old["role"]})
        yield from _batches(made, _LEFT)


def _with_key(rows: DataFrame) -> DataFrame:
    """Rows with null roles and texts as one space, and a text for each conversation that isn't null where its id is."""
    return rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, turn, role, text) -> (conversations, turns), either keyed by key, which _with_key derives from conv_id.

    conversations: key, gaps, blank, duplicate, truncated, illegal, cost, audit; a conversation without rows isn't there. turns: key,
    part, seg, pos, role, text, what is left in the order of part, seg and pos.

    Rows are in order of turn, null first; rows of one turn in that of role and of their texts' MD5, so that ties and repeated rows
    have a defined order. A null role or text is one space. Roles count by their first letter: s, u and a as they are, all others as
    illegal ones that can only be changed or deleted. Extra columns are ignored. An audit has a letter for every row, so it is as
    long as its conversation; everything else is spread by segments.
    """
    blank = ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    truncated = ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    rows = _with_key(rows).withColumn("h", F.md5(F.col("text").cast("binary")))
    plain = rows.groupBy("key", "turn", "role", "h", blank.alias("blank"), truncated.alias("cut")).agg(F.count("*").alias("n"))
    firsts = plain.groupBy("key", "role", "h").agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("from_null"))
    first = F.when(F.col("from_null"), F.col("turn").isNull()).otherwise(F.coalesce(F.col("turn") == F.col("least"), F.lit(False)))
    faults = materialise(plain.join(firsts, ["key", "role", "h"]).select("key", "turn", "role", "h", "n", "blank", "cut", first.alias("first")))

    own = F.when(F.col("first"), 1).otherwise(0)
    counts = faults.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - own).otherwise(0)).alias("duplicate"), F.sum(F.when(~F.col("blank") & F.col("cut"), own).otherwise(0)).cast("long").alias("truncated"),
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("blank") | ~F.col("first"), "-").otherwise(F.when(F.col("cut"), F.upper(F.when(initial.isin(*AFTER), initial).otherwise("x"))).otherwise(F.when(initial.isin(*AFTER), initial).otherwise("x")))
    order = ("key", F.asc_nulls_first("turn"), "role", "h")
    dealt = faults.select("key", "turn", "role", "h", F.when(initial.isin(*AFTER), initial).otherwise("x").alias("initial"), kind.alias("kind"), "n").repartitionByRange(*order).sortWithinPartitions(*order)
    segments = materialise(dealt.mapInArrow(_cut, SEGMENTS))

    whole = Window.partitionBy("key")
    place = Window.partitionBy("key").orderBy("part", "seg")
    bare = segments.select("key", "part", "seg", "first", "last", "illegal").withColumns({"n": F.count("*").over(whole), "before": F.lag("last").over(place)})
    bare = materialise(bare.withColumn("illegal", F.col("illegal") + F.when(F.concat("before", "first").isin(*LEGAL) | F.col("before").isNull(), 0).otherwise(1)))
    many = bare.where("n > 1").select("part", "seg")
    lone = segments.join(bare.where("n = 1").select("part", "seg"), ["part", "seg"], "left_semi").withColumn("ends", F.lit(None).cast("array<long>"))
    costs = segments.join(many, ["part", "seg"], "left_semi").select("key", "part", "seg", "kinds").mapInArrow(_matrices, "key string, part int, seg long, costs array<long>")
    ends = costs.groupBy("key").applyInArrow(_ends, "part int, seg long, ends array<long>")
    four = materialise(segments.join(ends, ["part", "seg"]).select("key", "part", "seg", "kinds", "ends").mapInArrow(_walks, WALKS))
    met = four.select("key", "part", "seg", "entry", "leaves").groupBy("key").applyInArrow(_entries, "part int, seg long, entry int")
    walks = materialise(lone.select("key", "part", "seg", "kinds", "ends").mapInArrow(_walks, WALKS).unionByName(four.join(met, ["part", "seg", "entry"]).select("key", "part", "seg", "entry", "leaves", "cost", "edits")))

    paths = walks.join(bare.select("part", "seg", "illegal"), ["part", "seg"]).groupBy("key").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seg", "edits"))), lambda x: x["edits"]), "").alias("audit")
    )
    kept = segments.select("part", "seg", "kinds", "names").join(walks, ["part", "seg"]).select("key", "part", "seg", "kinds", "names", "edits", "entry").mapInArrow(_left, "key string, part int, seg long, pos int, role string, h string, new_role string")
    texts = rows.select("key", "role", "h", "text").dropDuplicates(["key", "role", "h"])
    found = kept.where("h IS NOT NULL").join(texts, ["key", "role", "h"]).select("key", "part", "seg", "pos", F.col("new_role").alias("role"), "text")
    added = kept.where("h IS NULL").select("key", "part", "seg", "pos", F.col("new_role").alias("role"), F.lit("").alias("text"))
    turns = materialise(found.unionByName(added))
    out = materialise(counts.join(paths, "key"))
    discard(faults, segments, bare, four, walks)
    return out, turns


def damage(rows: DataFrame) -> DataFrame:
    """rows with a fault in about a quarter of them, by the CRC-32 of `conv_id:turn`, nulls as one space: dropped, emptied, without the marks that end sentences, repeated, or said by the user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    some = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), F.when(k == 1, "").when(k == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"), k.alias("k")).where("k <> 0")
    return some.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "k")


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of a conversation's `role:text`, joined by newlines. A digest can't be put together from parts, so a
    conversation's turns are read in one task, in order, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, shas = [], []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if sha is None or k != key:
                    if sha is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], names=["key", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["key", "repaired_sha256"])

    return turns.repartition("key").sortWithinPartitions("key", "part", "seg", "pos").select("key", "role", "text").mapInArrow(run, "key string, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, turns = repair_conversations(damage(rows))
    every = _with_key(rows).groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    out = every.join(found, "key", "left").join(digests(turns), "key", "left")
    none: Column = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(name) + 1), lambda i: ord(substr(name, CAST(i AS BIGINT), 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""


def _edit_sql(value: str, cost: str, letter: str, row: str) -> str:
    """A list of cost and letters, and of what is left, after one more edit."""
    left = f" || {row} || chr(10)" if row else ""
    return f"CASE WHEN {value} IS NOT NULL THEN [lpad(CAST(CAST(left({value}[1], 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({value}[1], 13) || '{letter}', {value}[2]{left}] END"


def _insert_sql(tables: str, columns: str) -> str:
    """tables, with u and a also reached by inserting rows."""
    user, assistant = lambda v: _edit_sql(v, "2", "I", "'user:'"), lambda v: _edit_sql(v, "2", "I", "'assistant:'")
    step = f"SELECT {columns}, n0, ns, least(nu, {user('n0')}, {user('ns')}, {user('na')}) AS nu, na FROM ({tables}) x1"
    step = f"SELECT {columns}, n0, ns, nu, least(na, {assistant('nu')}) AS na FROM ({step}) x2"
    return f"SELECT {columns}, n0, ns, least(nu, {user('na')}) AS nu, na FROM ({step}) x3"


def _row_sql(tables: str) -> str:
    keep = lambda v, initial: f"CASE WHEN NOT must AND initial = '{initial}' THEN {_edit_sql(v, 'extra', 'K', 'line')} END"
    change = lambda v, role: f"CASE WHEN NOT must THEN {_edit_sql(v, '2 + extra', 'R', role + ' || text')} END"
    drop = lambda v: _edit_sql(v, "3", "D", "")
    to_user = ", ".join(f"{keep(v, 'u')}, {change(v, repr('user:'))}" for v in ("n0", "ns", "na"))
    return f"""SELECT conv_id, i, n, {drop('n0')} AS n0, least({drop('ns')}, {keep('n0', 's')}) AS ns, least({drop('nu')}, {to_user}) AS nu,
      least({drop('na')}, {keep('nu', 'a')}, {change('nu', repr('assistant:'))}) AS na FROM ({tables}) y"""


_START = "[lpad('0', 12, '0'), '']"
OP11_SQL = rf"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), k AS (SELECT *, {_CRC_SQL} % 20 AS k FROM x), b AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    left(role, 1) AS initial, role || ':' || text AS line, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM b
), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o), f AS (
  SELECT *, blank OR nth > 1 AS must, CASE WHEN cut THEN 1 ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd FROM q
), d AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, n, {_START} AS n0, NULL::VARCHAR[] AS ns, NULL::VARCHAR[] AS nu, NULL::VARCHAR[] AS na FROM (SELECT DISTINCT conv_id, n FROM f) s
  UNION ALL
  {_row_sql(_insert_sql("SELECT d.conv_id, f.i, d.n, f.role, f.text, f.line, f.initial, f.must, f.extra, n0, ns, nu, na FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1", "conv_id, i, n, role, text, line, initial, must, extra"))}
), e AS (SELECT conv_id, least(n0, na, {_edit_sql("nu", "2", "I", "'assistant:'")}, {_edit_sql("(" + _edit_sql("ns", "2", "I", "'user:'") + ")", "2", "I", "'assistant:'")}) AS best FROM d WHERE i = n
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND nth > 1) AS duplicate,
    count(*) FILTER (WHERE NOT must AND cut) AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM f GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(best[1], 12) AS BIGINT), 0) AS cost, coalesce(substr(best[1], 13), '') AS audit, sha256(coalesce(CASE WHEN best[2] <> '' THEN left(best[2], -1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
