"""Units, scales, attribute names and periods in comparable form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlink.functions.text import SPACE, blank_if_null, let, strip

# Multipliers, aliases, months and words without meaning for an attribute's key.
SCALES = {"none": 1.0, "thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7, "billion": 1e9, "trillion": 1e12}
SCALE_ALIASES = {
    "million": ("mn", "mln", "millions"),
    "billion": ("bn", "billions"),
    "crore": ("cr", "crores"),
    "lakh": ("lakhs", "lacs", "lac"),
    "thousand": ("k", "thousands", "000s"),
}
UNITS = {
    "rs": "INR", "rs.": "INR", "₹": "INR", "inr": "INR", "rupees": "INR", "indian rupees": "INR", "rupee": "INR",
    "$": "USD", "us$": "USD", "usd": "USD", "us dollars": "USD", "dollars": "USD", "dollar": "USD",
    "percent": "%", "per cent": "%", "percentage": "%", "pct": "%", "%": "%",
    "percentage points": "pp", "pp": "pp", "bps": "bps", "basis points": "bps",
    "number": "count", "nos": "count", "nos.": "count", "units": "count", "no.": "count",
    "people": "persons", "employees": "persons", "persons": "persons",
    "x": "x", "times": "x",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STOP_WORDS = ("the", "of", "for", "in", "as", "at", "on", "and", "to", "a", "an", "total")


def _table(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def unit_norm(unit: Column) -> Column:
    """The canonical unit; an unknown one as it is but for white space."""
    plain = strip(blank_if_null(unit))
    return F.coalesce(F.try_element_at(_table(UNITS), F.lower(plain)), plain)


def scale_norm(scale: Column) -> Column:
    """One of the scales; none for everything else."""
    known = {s: s for s in SCALES} | {a: s for s, aliases in SCALE_ALIASES.items() for a in aliases}
    return F.coalesce(F.try_element_at(_table(known), F.lower(strip(blank_if_null(scale)))), F.lit("none"))


def value_norm(value: Column, scale: Column) -> Column:
    return value.cast("double") * F.try_element_at(_table(SCALES), scale_norm(scale))


def attribute_key(attribute: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(blank_if_null(attribute)), "[^a-z0-9]+", " "), " ")
    key = F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)), "_")
    return F.when(key == "", "unknown").otherwise(key)


def fiscal_start_month(convention: Column) -> Column:
    """1, 7, 10 or 4 by what a document says about its years."""
    said = F.lower(blank_if_null(convention))
    has = lambda *names: [F.contains(said, F.lit(n)) for n in names]
    calendar, april = has("calendar", "april")
    july, june = has("july", "june")
    october, september = has("october", "september")
    return F.when(calendar & ~april, 1).when(july & june, 7).when(october & september, 10).otherwise(4)


# How dates and years are written.
_DATE = r"\b(\d{1,2})\s*(?:st|nd|rd|th)?\s+([A-Za-z]+),?\s+(20\d{2})\b|\b([A-Za-z]+)\s+(\d{1,2}),?\s+(20\d{2})\b"
_FISCAL = r"(?i)\bFY\s*'?(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?\b"
_SPAN = r"\b(20\d{2})\s*[-/]\s*(\d{2,4})\b"


def _groups(text: Column, pattern: str, **names: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, g).alias(n) for n, g in names.items()]


def _whole(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("int")


def _read(text: Column) -> Column:
    """What the patterns find in a label."""
    dates = _groups(text, _DATE, day=1, month=2, year=3, month2=4, day2=5, year2=6)
    fiscal = F.regexp_like(text, F.lit(_FISCAL))
    years = [F.when(fiscal, F.regexp_extract(text, _FISCAL, g)).otherwise(F.regexp_extract(text, _SPAN, g)).alias(n) for n, g in (("of", 1), ("to", 2))]
    alone = _groups(text, rf"\A[{SPACE}]*(20\d{{2}})[{SPACE}]*\z", alone=1)
    return F.struct(*dates, *years, *alone, *_groups(text, r"(?i)\bQ([1-4])\b", quarter=1), *_groups(text, r"(?i)\bH([12])\b", half=1))


def _dated(r: Column, start_month: Column) -> Column:
    """The found parts as dates and numbers."""
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.when(r["day"] != "", r["month"]).otherwise(r["month2"]))).cast("int")
    year = _whole(F.when(r["day"] != "", r["year"]).otherwise(r["year2"]))
    end = _whole(F.when(r["to"] != "", r["to"]).otherwise(r["of"]))
    end = F.when(end > 100, end).otherwise(end + 2000)
    return F.struct(
        _whole(F.when(r["day"] != "", r["day"]).otherwise(r["day2"])).alias("day"),
        F.when((number > 0) & year.isNotNull(), F.make_date(year, number, F.lit(1))).alias("month"),
        F.make_date(F.when(start_month == 1, end).otherwise(end - 1), start_month, F.lit(1)).alias("first"),
        _whole(r["quarter"]).alias("quarter"),
        _whole(r["half"]).alias("half"),
        _whole(r["alone"]).alias("alone"),
    )


def _period(d: Column, start_month: Column) -> Column:
    def made(a: Column, b: Column, kind) -> Column:
        return F.struct(a.cast("string").alias("start"), b.cast("string").alias("end"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))

    def part(n: Column, months: int, kind: str) -> Column:
        return made(F.add_months(d["first"], (n - 1) * months), F.date_sub(F.add_months(d["first"], n * months), 1), kind)

    point = F.date_add(d["month"], d["day"] - 1)
    yearly = F.when(start_month == 1, "calendar_year").otherwise("fiscal_year")
    return (
        F.when((d["day"] >= 1) & (d["day"] <= F.dayofmonth(F.last_day(d["month"]))), made(point, point, "point_in_time"))
        .when(d["first"].isNotNull() & d["quarter"].isNotNull(), part(d["quarter"], 3, "quarter"))
        .when(d["first"].isNotNull() & d["half"].isNotNull(), part(d["half"], 6, "half_year"))
        .when(d["first"].isNotNull(), made(d["first"], F.date_sub(F.add_months(d["first"], 12), 1), yearly))
        .when(d["alone"].isNotNull(), made(F.make_date(d["alone"], F.lit(1), F.lit(1)), F.make_date(d["alone"], F.lit(12), F.lit(31)), "calendar_year"))
    )


def parse_period(label: Column, start_month: Column) -> Column:
    """struct(start, end, type), dates as ISO strings, of a period's label; null if no rule reads it.

    The first rule that applies: a full date; a fiscal year or a span of years, with a quarter or a half of it; a bare year.
    """
    return let(_read(strip(blank_if_null(label))), lambda r: let(_dated(r, start_month), lambda d: _period(d, start_month)))
