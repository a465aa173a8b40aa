"""Text expressions: white space, page cleaning, locating quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() knows it, for use in a Java character class (fixed values).
SPACE = r"\t\n\u000B\f\r\u001C-\u001F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_IN_LINE = SPACE.replace(r"\n", "")


def strip(text: Column) -> Column:
    """Without white space at both ends; trim() only knows the space."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, for expressions that use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean_text(text: Column) -> Column:
    """Carriage returns and form feeds as newlines, single spaces, stripped lines, at most one blank line in a row."""
    lines = F.regexp_replace(F.translate(text, "\r\f", "\n\n"), r"[ \t\u00A0]+", " ")
    lines = F.regexp_replace(lines, rf"(?md)^[{_IN_LINE}]+|[{_IN_LINE}]+$", "")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def find(text: Column, part: Column) -> Column:
    """0-based code-point offset of part in text, null if it isn't there."""
    at = F.instr(text, part) - 1
    return F.when(at >= 0, at)


def loose_pattern(quote: Column) -> Column:
    """A pattern for the quote that ignores case and takes any run of white space for any other."""
    tokens = F.filter(F.split(quote, f"[{SPACE}]+"), lambda t: t != "")
    literal = F.transform(tokens, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?iu)"), F.array_join(literal, f"[{SPACE}]+"))


def locate(text: Column, quote: Column) -> Column:
    """struct(score, start, end) of a stripped quote in a text: 100 where it stands verbatim, 99 but for case and white space, else null."""
    place = lambda score, start, size: F.struct(F.lit(score).alias("score"), start.alias("start"), (start + size).alias("end"))
    found = F.call_function("regexp_extract", text, loose_pattern(quote), F.lit(0))
    loose = let(found, lambda x: F.when(x != "", let(F.instr(text, x) - 1, lambda at: place(99.0, at, F.length(x)))))
    return let(F.instr(text, quote) - 1, lambda at: F.when(at >= 0, place(100.0, at, F.length(quote))).otherwise(loose))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_like(columns: list[Column], asked: str) -> Column:
    """Whether one of the columns is LIKE %asked%, folding ASCII case; % and _ in what is asked are wildcards, nothing escapes them."""
    pattern = F.lit(f"%{asked.translate(str.maketrans('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))}%")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.like(ascii_lower(c), pattern, F.lit("\x01")), F.lit(False))
    return out
