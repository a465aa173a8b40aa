"""The reference rules on literal inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimlink.functions import helpers, normalize, text
from claimlink.operators import chunks, ground, link

PAGE = "FY24\n\n₹8,142 Cr ₹127Cr / 1.6% ₹76Cr / 0.9%\nFY24 revenue from services EBITDA / EBITDA margin Adj. EBITDA\n"
FACT = "fact_id string, doc_id string, page int, page_start int, page_end int, kind string, value_num double, quote string, confidence double, flags array<string>"


@pytest.mark.parametrize("found", [None])
def test_periods(spark, found):
    cases = [
        ("FY24", 4, ("2023-04-01", "2024-03-31", "fiscal_year")),
        ("FY 2023-24", 4, ("2023-04-01", "2024-03-31", "fiscal_year")),
        ("2024-25", 4, ("2024-04-01", "2025-03-31", "fiscal_year")),
        ("Q4 FY24", 4, ("2024-01-01", "2024-03-31", "quarter")),
        ("H1:2025-26", 4, ("2025-04-01", "2025-09-30", "half_year")),
        ("as at 31 March 2024", 4, ("2024-03-31", "2024-03-31", "point_in_time")),
        ("2024", 1, ("2024-01-01", "2024-12-31", "calendar_year")),
        ("FY24", 7, ("2023-07-01", "2024-06-30", "fiscal_year")),
        ("Q4FY24", 4, None),
        ("2024-03-31", 4, ("2002-04-01", "2003-03-31", "fiscal_year")),
        ("FY24-25", 4, ("2024-04-01", "2025-03-31", "fiscal_year")),
        ("30 February 2024 FY24", 4, ("2023-04-01", "2024-03-31", "fiscal_year")),
        ("Q4 2024", 4, None),
        ("", 4, None),
        (None, 4, None),
    ]
    rows = spark.createDataFrame([(i, a, m) for i, (a, m, _) in enumerate(cases)], "i int, label string, m int")
    got = {r["i"]: r["p"] for r in rows.select("i", normalize.parse_period(F.col("label"), F.col("m")).alias("p")).collect()}
    assert [None if got[i] is None else tuple(got[i]) for i in range(len(cases))] == [e for _, _, e in cases]


def test_units_scales_keys(spark):
    rows = spark.createDataFrame([("Rs.", "crore", 8141.9, "Total Revenue from Operations"), ("₹", "BN", 81.419, "₹₹"), (" INR ", None, None, None), ("tonnes", "dozens", 2.0, "the")], "u string, s string, v double, a string")
    got = rows.select(normalize.unit_norm(F.col("u")), normalize.scale_norm(F.col("s")), normalize.value_norm(F.col("v"), F.col("s")), normalize.attribute_key(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("INR", "crore", 8141.9 * 1e7, "revenue_from_operations"), ("INR", "billion", 81.419 * 1e9, "unknown"), ("INR", "none", None, "unknown"), ("tonnes", "none", 2.0, "unknown")]


def test_fiscal_start_month(spark):
    rows = spark.createDataFrame([("calendar years",), ("calendar, April to March",), ("July to June",), ("October-September",), (None,)], "c string")
    assert [r[0] for r in rows.select(normalize.fiscal_start_month(F.col("c"))).collect()] == [1, 4, 7, 10, 4]


def test_numbers_in_texts():
    assert helpers.is_number_in(8141, "revenue of Rs 8,141 crore") and helpers.is_number_in(6.5, "grew by 6.5 per cent")
    assert not helpers.is_number_in(8141, "revenue of Rs 7,225 crore")
    assert helpers.is_number_in(8141, "18141") and helpers.is_number_in(-296.99, "(296.99)") and helpers.is_number_in(2.5, "2")
    assert helpers.is_number_in(None, "1") is None


def test_cleaning(spark):
    got = spark.createDataFrame([("a \t b\r\n\r\n\r\n\f x   y  \n  z  ",)], "t string").select(text.clean_text(F.col("t"))).first()[0]
    assert got == "a b\n\nx y\nz"


def test_offsets_are_code_points(spark):
    rows = spark.createDataFrame([("😀 a b\r\nC  d", "A B c D"), ("x.y\\Ez", "Y\\ez"), ("abc", "zz"), (PAGE, "₹8,142 Cr ₹127Cr / 1.6%")], "t string, q string")
    got = [r[0] and tuple(r[0]) for r in rows.select(text.locate(F.col("t"), F.col("q"))).collect()]
    assert got == [(99.0, 2, 11), (99.0, 2, 6), None, (100.0, 6, 29)]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _brute(quote, page, least=85.0):
    if len(quote) > len(page):
        found = _brute(page, quote, least)
        return found and (found[0], 0, len(page))
    best = None
    for s in range(-len(quote) + 1, len(page)):
        a, b = max(0, s), min(len(page), s + len(quote))
        score = 200.0 * _common(quote, page[a:b]) / (len(quote) + b - a)
        if score >= least and (best is None or score > best[0]):
            best = (score, a, b)
    return best


def test_alignment_agrees_with_brute_force():
    import random

    rng = random.Random(3)
    words = ["revenue", "rose", "by", "nine", "percent", "in", "the", "year", "costs", "fell"]
    for _ in range(40):
        page = " ".join(rng.choices(words, k=40))
        at = rng.randrange(len(page) - 60)
        quote = "".join(c if rng.random() > 0.08 else rng.choice(["#", ""]) for c in page[at : at + 50])
        assert helpers.align(quote, page) == _brute(quote, page)
    assert helpers.align("₹8,142 Cr\nFY24 revenue from services", PAGE) is None  # its best score is 80.56
    assert round(helpers.align("₹8,142 Cr\nFY24 revenue from services", PAGE, 80.0)[0], 2) == 80.56
    assert helpers.align("", "x") is None and helpers.align("x", "") is None


def test_alignment_of_any_lengths_agrees_with_brute_force():
    import random

    rng, hits = random.Random(4), 0
    for _ in range(70):
        letters = rng.choice(["abcd ef", "abcdefghijklmnop qrstuvwxyz", "aé😀 b"])
        page = "".join(rng.choices(letters, k=rng.randint(1, 170)))
        at = rng.randrange(len(page))
        quote = "".join(rng.choice([c] * 20 + ["", "x", c + "y"]) for c in page[at : at + rng.randint(1, 140)]) or "a"
        quote += "".join(rng.choices(letters, k=rng.choice([0, 0, 0, 90])))
        expected = _brute(quote, page)
        hits += expected is not None
        assert helpers.align(quote, page) == expected == helpers.align(quote, helpers.Page(page))
    assert hits > 15


def _densest(quote, page):
    """Tries every run of the tokens' first places, from each of them on."""
    tokens = helpers._TOKEN.findall(quote)
    spots = sorted((page.lower().find(t.lower()), len(t)) for t in tokens if t.lower() in page.lower())
    needed = max(2, int(0.8 * len(tokens)))
    if len(tokens) < 2 or any(t[0].isdigit() and t.lower() not in page.lower() for t in tokens):
        return None
    best = None
    for i in range(len(spots)):
        for j in range(i, len(spots)):
            if all(p + n - spots[i][0] <= 800 for p, n in spots[i + 1 : j + 1]) and j + 1 - i >= needed and (best is None or j + 1 - i > best[0]):
                best = (j + 1 - i, spots[i][0], sum(spots[j]))
    return best and (100.0 * best[0] / len(tokens), *best[1:])


def test_token_windows_agree_with_brute_force():
    import random

    rng, known = random.Random(5), ["alpha", "beta", "12", "1,234", "gamma", "delta9", "x" * 900, "İlk", "word", "7"]
    pairs = [("", ""), ("alpha beta", ""), ("a", "a"), ("word word", "Word")]
    for _ in range(400):
        page = " ".join(rng.choice([*known, "zz" * rng.randint(0, 40)]) for _ in range(rng.randint(1, 200)))
        pairs.append((" ".join(rng.choices(known, weights=[5, 5, 5, 5, 5, 5, 0.3, 1, 5, 5], k=rng.randint(1, 12))), page))
    expected = [_densest(*p) for p in pairs]
    assert helpers.token_windows(pairs) == expected == [helpers.token_window(*p) for p in pairs]
    assert sum(x is not None for x in expected) > 50


def _ground(spark, facts, pages, tiers="all"):
    rows = spark.createDataFrame(facts, FACT)
    texts = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages, 1)], "doc_id string, page_no int, text string")
    return {r["fact_id"]: r for r in ground.ground(rows, texts, tiers).collect()}


def test_grounding(spark):
    got = _ground(
        spark,
        [
            ("exact", "d", 1, None, None, "numeric", 8142.0, "₹8,142 Cr ₹127Cr / 1.6%", 0.9, []),
            ("window", "d", 1, None, None, "numeric", 8142.0, "₹8,142 Cr\nFY24 revenue from services", 0.9, None),
            ("missing", "d", 1, None, None, "numeric", 9999.0, "this sentence is not on the page at all", 0.9, ["quote_old", "kept"]),
            ("moved", "d", 2, 1, 2, "numeric", 8142.0, "₹8,142 Cr ₹127Cr", 0.0, []),
            ("empty", "d", 2, None, None, "statement", None, " ", 0.1, []),
            ("nowhere", "x", None, None, None, "numeric", None, "abc", None, []),
        ],
        [PAGE, "another page"],
    )
    assert (got["exact"].grounding, got["exact"].flags) == ("exact", []) and PAGE[got["exact"].quote_start : got["exact"].quote_end] == "₹8,142 Cr ₹127Cr / 1.6%"
    assert got["window"].grounding == "window" and got["window"].flags == ["quote_not_contiguous"] and "8,142" in PAGE[got["window"].quote_start : got["window"].quote_end]
    assert got["missing"].grounding == "unverified" and got["missing"].flags == ["kept", "quote_not_found", "value_not_in_quote"]
    assert got["moved"].page == 1 and got["moved"].flags == ["page_corrected:2->1"]
    assert got["empty"].flags == ["empty_quote", "quote_not_found", "low_confidence"]
    assert got["nowhere"].flags == ["quote_not_found", "numeric_without_value"]


def test_tier_order(spark):
    sentence = "The company reported a strong growth of its revenue in the year."
    near = sentence.replace("strong growth", "strung grawth")
    got = _ground(spark, [("late_exact", "d", 1, 1, 2, "statement", None, sentence, 1.0, [])], [near, sentence])
    assert (got["late_exact"].grounding, got["late_exact"].page) == ("exact", 2)
    sure = sentence.replace("strong", "strunk")
    long = sentence + " It expects the same for the year that follows, and says so in its report."
    got = _ground(spark, [("sure_fuzzy", "d", 1, 1, 2, "statement", None, long, 1.0, [])], [long.replace("strong", "strung"), long])
    assert (got["sure_fuzzy"].grounding, got["sure_fuzzy"].page) == ("fuzzy", 1) and sure


def test_chunks(spark):
    pages = ["a" * 5000, "b" * 5000, "", "c" * 9000, "d" * 2500 + "\n\n" + "e" * 12000]
    rows = spark.createDataFrame([("doc", i, t) for i, t in enumerate(pages, 1)], "doc_id string, page_no int, text string")
    got = sorted(chunks.make_chunks(rows, 10_000).collect(), key=lambda r: (r.page_start, r.chunk_id))
    assert [(r.chunk_id, len(r.text)) for r in got] == [("doc:1-2", 10_024), ("doc:4-4", 9011), ("doc:5-5#0", 2511), ("doc:5-5#1", 10_011), ("doc:5-5#2", 2011)]
    assert "[[page 1]]" in got[0].text and "[[page 2]]" in got[0].text
    assert chunks.make_chunks(rows.limit(0), 10).count() == 0


def _fact(name, doc, **kw):
    base = {"id": name, "doc_id": doc, "kind": "numeric", "attribute_key": "revenue", "unit": "INR", "period_start": "2023-04-01", "period_end": "2024-03-31", "basis": "", "scope": "", "value_text": "1", "scale": "crore", "value_norm": 8141.9e7}
    return tuple((base | kw).values())


def test_arithmetic_only_speaks_when_all_else_is_equal(spark):
    schema = "id string, doc_id string, kind string, attribute_key string, unit string, period_start string, period_end string, basis string, scope string, value_text string, scale string, value_norm double"
    rows = [_fact("a", "x"), _fact("b", "y", value_norm=8142e7), _fact("c", "z", period_start="2022-04-01"), _fact("d", "v", value_norm=7000e7), _fact("e", "w", basis="consolidated"), _fact("f", "u", scope="segment"), _fact("g", "x"), _fact("h", "t", value_norm=None)]
    got = link.numeric_matches(spark.createDataFrame(rows, schema)).collect()
    assert {(r.fact_a, r.fact_b) for r in got} == {("a", "b"), ("a", "e"), ("b", "e"), ("b", "g"), ("e", "g")}


def test_quotes_aligned_together_are_compared_at_once(monkeypatch):
    rng = random.Random(4)
    pairs = []
    for _ in range(120):
        text = "".join(rng.choices("abcdefgh é", k=rng.choice([0, 5, 64, 65, 300])))
        quote = list(text[rng.randint(0, 60) :][: rng.choice([20, 63, 64, 65, 130])] or "a")
        for _ in range(len(quote) // 9):
            quote[rng.randrange(len(quote))] = "x"
        pairs.append(("".join(quote), text))
    alone, calls, compare = [helpers.align(q, t) for q, t in pairs], [], helpers._subsequences
    monkeypatch.setattr(helpers, "_subsequences", lambda *a: calls.append(1) or compare(*a))
    assert helpers.align_all(pairs) == alone and sum(x is not None for x in alone) > 20 > len(calls)
    for name, least in (("AT_ONCE", 5), ("MOST_PLACES", 100), ("MOST_SHARED", 10)):
        monkeypatch.setattr(helpers, name, least)
        assert helpers.align_all(pairs) == alone
