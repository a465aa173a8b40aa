"""Chat formatting with typed content parts.

A visitor flattens each turn's text, image, audio and document parts into one string with ordered placeholders, and records
which attachment each placeholder stands for and how many tokens it expands to. Control strings in roles and texts are escaped
reversibly, so that no text can end its turn or open another one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings. A turn is `### role: content</turn>\n`; a placeholder is `<|kind|>`.
OPEN, CLOSE, SLOT = "### ", "</turn>", "<|"
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", "<|": "\\p"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_ESCAPE, _UNESCAPE, _ROLE = re.compile(r"\\|###|</turn>|<\|"), re.compile(r"\\(.)", re.S), re.compile(r"\\c")
_TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)

PART = "struct<kind:string,text:string,ref:string,n_tokens:long>"
TURNS = f"array<struct<turn:long,role:string,parts:array<{PART}>>>"
FORMATTED = "formatted string, attachments array<struct<position:int,turn:int,kind:string,ref:string,n_tokens:long>>, loss_spans array<struct<start:long,length:long>>, n_expanded_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK.get(m[1], ":" if m[1] == "c" else m[1]), text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\c")


class Flattener:
    """Visits the parts of one conversation in order. Unknown kinds are taken as documents; null texts are empty."""

    def __init__(self, default_tokens: dict[str, int]) -> None:
        self.default_tokens, self.out, self.at = default_tokens, [], 0
        self.attachments: list[dict] = []
        self.loss: list[dict] = []
        self.expanded = 0

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_turn(self, number: int, role: str, parts: list[dict], learn: bool) -> None:
        self.put(f"{OPEN}{escape_role(role)}: ")
        for part in parts:
            kind = part["kind"] or "text"
            if kind == "text":
                self.visit_text(part["text"] or "", learn)
            else:
                self.visit_attachment(number, kind if kind in self.default_tokens else "document", part)
        self.put(f"{CLOSE}\n")

    def visit_text(self, text: str, learn: bool) -> None:
        shown = escape(text)
        if learn:
            self.loss.append({"start": self.at, "length": len(shown)})
        self.put(shown)

    def visit_attachment(self, number: int, kind: str, part: dict) -> None:
        tokens = part["n_tokens"] if part["n_tokens"] is not None else self.default_tokens[kind]
        self.attachments.append({"position": len(self.attachments), "turn": number, "kind": kind, "ref": part["ref"], "n_tokens": tokens})
        self.expanded += tokens
        self.put(f"{SLOT}{kind}|>")


def format_chats(chats: DataFrame, id_column: str, learn_roles: tuple[str, ...] = ("assistant",), default_tokens: dict[str, int] | None = None) -> DataFrame:
    """chats (id_column, turns as TURNS in any order) -> id_column, turns sorted, and FORMATTED, one row for each row.

    Turns are ordered by turn (null first), role and parts, so repeated numbers have a defined order; a conversation without
    turns has an empty string. loss_spans place, in code points of the formatted string, every text of the roles to be learnt.
    """
    sizes = default_tokens or {"image": 256, "audio": 128, "document": 512}
    id_type = chats.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns in batch.column(1).to_pylist():
                visitor = Flattener(sizes)
                for number, turn in enumerate(turns or []):
                    role = turn["role"] or ""
                    visitor.visit_turn(number, role, turn["parts"] or [], role in learn_roles)
                rows.append({"formatted": "".join(visitor.out), "attachments": visitor.attachments, "loss_spans": visitor.loss, "n_expanded_tokens": visitor.expanded})
            made = pa.Table.from_pylist(rows, schema=_ARROW).combine_chunks().to_batches()
            for part in made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *part.columns], names=[id_column, *part.schema.names])

    return chats.select(id_column, F.array_sort("turns").alias("turns")).mapInArrow(run, f"`{id_column}` {id_type}, {FORMATTED}")


_ARROW = pa.schema([
    ("formatted", pa.string()),
    ("attachments", pa.list_(pa.struct([("position", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())]))),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ("n_expanded_tokens", pa.int64()),
])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; placeholders stay as they are."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def text_turns(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rows of (conv, turn, role, text) as conversations whose turns have one text part each."""
    part: Column = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role"), F.array(part).alias("parts"))
    return rows.groupBy(conv).agg(F.collect_list(turn).alias("turns"))


def digests(formatted: DataFrame, id_column: str) -> DataFrame:
    """Digests of what is read back from the formatted strings."""
    id_type = formatted.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                sha = hashlib.sha256()
                for role, content in turns:
                    sha.update(f"{role}\n{content}\n".encode())
                for cell, value in zip(cells, (len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    cell.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cells, kinds)], names=[id_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(id_column, "formatted", "loss_spans").mapInArrow(run, f"`{id_column}` {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trial = spark.sql(r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(format_chats(text_turns(rows.unionByName(trial)), "conv_id"), "conv_id")
