"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with the odd rows that tables hold."""

from __future__ import annotations

import collections
import hashlib
import html.parser
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from claimlink.llm import chat_format, factor_quality, html_text, jaccard_join, packing, pieces, quality_rules, repeats, shared, topk, url_filter
from claimlink.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"
ODD = [None, "", " \n\t ", "one", "two words", "İ ß ſ \x1c x\x85y\xa0z", "a  b   c \n \n d", "<|endoftext|> and <s> ▁▁ x", "x" * 3000, "same same same same " * 40]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))))
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = ODD + random_texts(150) + [ODD[8]]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def shingles(text, n):
    w = WORD.findall((text or "").encode().lower())
    return frozenset({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else ()))


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return {(doc, len(s), smallest[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 60)])
def test_op1_finds_every_link(docs, rows, n, percent):
    got = jaccard_join.link_documents(docs.withColumn("node", F.lit(1)), n, percent)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, n, percent)


def test_op1_hot_group_is_split(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    assert {tuple(r) for r in jaccard_join.link_documents(docs, 3, 70).collect()} == brute_components(rows, 3, 70)


def test_op1_hot_keys_are_aggregated(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    assert {tuple(r) for r in jaccard_join.link_documents(docs, 2, 60).collect()} == brute_components(rows, 2, 60)


def test_op1_sparse_sets_meet_by_content():
    rng = np.random.default_rng(2)
    bands = jaccard_join.Bands(80)
    sets = [np.unique(rng.integers(0, 1 << 63, 11).astype(np.uint64)) for _ in range(3000)]
    keys = collections.Counter(k for s in sets for k in np.unique(bands.keys(s)).tolist())
    assert max(keys.values()) < 5  # sets without anything in common don't share keys


def test_op1_bands_share_a_key():
    rng = np.random.default_rng(1)
    bands = jaccard_join.Bands(85)
    for size in (1, 2, 5, 7, 13, 40, 333):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            most = max(d for d in range(size + 1) if 100 * (size - d) >= 85 * size)
            b = a[rng.permutation(size)[most:]]
            assert np.intersect1d(bands.keys(a), bands.keys(np.sort(b))).size


def test_op1_empty_and_repeated_rows(spark):
    assert jaccard_join.link_documents(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, None)], DOCS)
    assert sorted((tuple(r) for r in jaccard_join.link_documents(twice).collect()), key=repr) == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (1, 0, 1)], key=repr)
    assert jaccard_join.first_of_each_group(twice).count() == 2


def test_op1_links_rows_without_ids(spark):
    base = [f"w{i}" for i in range(120)]
    near = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    far = lambda k: " ".join(f"{k}v{i}" for i in range(30))
    # 9 and 3 are linked only by way of rows without ids; two such rows are linked with each other, one with nothing
    rows = [(9, near()), (None, near(4)), (None, near(4, 60)), (3, near(4, 60, 100)), (None, near(4)), (None, far("a")), (None, far("a") + " end"), (None, far("b")), (5, far("c")), (None, "")]
    got = sorted(map(tuple, jaccard_join.link_documents(spark.createDataFrame(rows, DOCS).repartition(3), 4, 85).collect()), key=repr)
    expected = [(i, len(shingles(t, 4)), {**dict.fromkeys(range(5), 3), 8: 5}.get(k)) for k, (i, t) in enumerate(rows)]
    assert got == sorted(expected, key=repr)


def test_words_that_differ_have_different_hashes():
    regular = [b"a"]
    while len(regular[-1]) < 4096:
        regular.append(regular[-1] + regular[-1].translate(bytes.maketrans(b"ab", b"ba")))  # Thue and Morse's word
    texts = [w for x in regular for w in (x, x.translate(bytes.maketrans(b"ab", b"ba")))]
    rng = random.Random(1)
    texts += list({bytes(rng.choices(b"abc", k=rng.randint(1, 40))) for _ in range(4000)} - set(texts))
    hashes, start, end, _ = shared.words([b" ".join(texts)])
    assert len(set(hashes.tolist())) == len(texts) == len(hashes)
    again = shared.words([b"  " + b"\n".join(texts[::-1]), b"z"])[0]
    assert again[:-1][::-1].tolist() == hashes.tolist() and (end - start).tolist() == [len(t) for t in texts]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_op2_packs_everything_once(docs, rows):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    for capacity in (1024, 64):
        by, seen = collections.defaultdict(list), collections.Counter()
        for r in packing.pack(docs, capacity).collect():
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.length == capacity or r.piece == 0
            by[r.sequence_id].append((r.offset, r.length))
            seen[r.doc_id] += r.length
        assert seen == {i: len(x) for i, x in ids.items()}
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(by) <= 1.1 * -(-sum(map(len, ids.values())) // capacity) + 1


def test_op2_fullest_combination():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(k <= counts[n] for n, k in got.items())


def test_op2_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, library = packing.ByteLevelEncoder(path), tokenizers.Tokenizer.from_file(path)
    for t in [*random_texts(40, 9), *filter(None, ODD), "don't  stop", " \n a", "a \n \n b", "x ", "É, é! naïve² Ⅷ_b 3rd", "\u3000a b\u2028 c"]:
        assert small.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_op2_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_op3_keeps_the_article_only(spark):
    body = "<p>First &amp; <b>bold</b>\n  text &eacute;.</p><p>Short.</p><div class='share'>Share me</div><p>" + "Long text " * 20 + "</p>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><header>Top</header><div class=\"ad\">Buy</div><article><h1>Head</h1>{body}<form>Name</form><section id=comments><p>{'I agree ' * 30}</p></section></article><aside>Side</aside><footer>&copy; us</footer></body></html>"
    expected = "Head\nFirst & bold text é.\nShort.\n" + ("Long text " * 20).strip()
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>only"), (5, "u", "<script>x"), (6, "u", "a < b > c")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == expected and got[1].n_chars == len(expected)
    assert [got[i].text for i in (2, 3, 4, 5)] == ["", "", "only", ""] and got[6].text == "a < b > c"


def test_op3_windows_without_an_article_element():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(12)) + "</ul>"
    page = f"<body>{links}<p>{'This is the text of the page. ' * 5}</p><p>Short one.</p><p>{'And it goes on for a while. ' * 5}</p>{links}</body>"
    assert html_text.main_text(page).split("\n")[0].startswith("This is") and "Menu" not in html_text.main_text(page) and "Short one." in html_text.main_text(page)


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class='has-sidebar'", "form id='aspnetForm'", "div class='related'", "div class='page menu-open'"])
def test_op3_wrappers_are_no_asides(wrapper):
    end = wrapper.split()[0]
    aside = "<div class='sidebar'><p>Aside text.</p></div><nav><a href=/>Home</a></nav><section id='comments'><article>I agree.</article></section>"
    text = "This is the text of the page. " * 5
    for tag in ("main", "article"):
        page = f"<body><p>Outside.</p><{wrapper}>{aside}<{tag}><h1>Head</h1><p>{text}</p></{tag}></{end}><footer>Us</footer></body>"
        assert html_text.main_text(page).split("\n") == (["Head", text.strip()] if "related" not in wrapper or tag == "main" else ["Outside."])
    page = f"<body><{wrapper}>{aside}<p>{text}</p><p>Short.</p></{end}><footer>Us</footer></body>"
    assert html_text.main_text(page).split("\n")[-2:] == [text.strip(), "Short."]


def test_op3_deep_wrappers():
    for depth in (3, 3000):
        assert html_text.main_text("<div class='sidebar-wrap sidebar'>" * depth + "<article>Text.</article>" + "</div>" * depth) == "Text."


def test_op3_asides_beside_the_article_stay_asides():
    talk = "<article>I agree with all of this. </article>" * 9
    for aside in (f"<section id='comments'>{talk}</section>", f"<div class='related'>{talk}</div>", f"<aside>{talk}</aside>", "<div class='sidebar'><article>Teaser</article></div>"):
        assert html_text.main_text(f"<body><article>Short text.</article>{aside}</body>") == "Short text."
        assert html_text.main_text(f"<body><p>{'Plain text. ' * 9}</p>{aside}</body>") == ("Plain text. " * 9).strip()


def test_op3_keeps_all_between_surge_and_dive():
    text = "This is the text of the page. " * 5
    page = f"<body><p>{text}</p><p><a href=/1>A paragraph that is a link</a></p><p>Short.</p><p><a href=/2>Another</a></p><p>{text}</p></body>"
    assert html_text.main_text(page).split("\n") == [text.strip(), "A paragraph that is a link", "Short.", "Another", text.strip()]
    assert html_text.main_text("<p>One.</p><p>Two.</p><p>Three is longer.</p>") == "One.\nTwo.\nThree is longer."


def brute_surge_to_dive(lengths, window=3, surge=60):
    """By trying every window, line by line."""
    n = len(lengths)
    surges = [i for i in range(n) if lengths[i] > 0 and sum(lengths[i : i + window]) >= surge]
    held = [i for i in range(n) if lengths[i] > 0]
    if not surges:
        return (held[0], held[-1] + 1) if held else (0, 0)
    first, last = surges[0], surges[-1]
    while any(lengths[max(0, first - window) : first]):
        first = next(i for i in range(max(0, first - window), first) if lengths[i])
    while any(lengths[last + 1 : last + 1 + window]):
        last = next(i for i in range(last + 1, n) if lengths[i])
    return first, last + 1


def test_op3_windows_equal_brute_force():
    rng = random.Random(11)
    for _ in range(3000):
        lengths = [rng.choice([0, 0, 0, 5, 15, 30, 70]) for _ in range(rng.randint(0, 25))]
        assert html_text.surge_to_dive(np.array(lengths, np.int64)) == brute_surge_to_dive(lengths), lengths


class Reader(html.parser.HTMLParser):
    """The lines of an article by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.lines, self.part, self.depth, self.skip = [], "", 0, 0

    def end_line(self):
        line = " ".join(self.part.split())
        self.lines += [line] if line else []
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.INLINE:
            self.end_line()
        self.depth += tag == "article"
        self.skip += tag in ("nav", "script", "form")

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.end_line()
        self.depth -= tag == "article"
        self.skip -= tag in ("nav", "script", "form")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.part += data


def test_op3_equals_another_parser():
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices(["word", "caf&eacute;", "a &lt; b", "1 < 2", "it's", "\"so\"", "&#8364;", "x=y", "\n"], k=rng.randint(1, 12)))
    attributes = lambda: rng.choice(["", " class=x", " title='a > b'", ' data-a="<p>" id=q', " hidden2", " href=/a/b/", ' alt="hidden"'])

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return text()
        tag = rng.choice(["p", "div", "b", "a", "section", "ul", "nav", "blockquote"])
        inner = "".join(node(depth - 1 if tag != "p" else 0) for _ in range(rng.randint(1, 3)))
        return rng.choice(["<!-- <p>x</p> -->", "<br>", "<hr/>", "<script>if (a<b) '</p>'</script>"]) if kind < 0.4 else f"<{tag}{attributes()}>{inner}</{tag}>"

    for _ in range(300):
        page = f"<html><body><nav><a href=/>Home</a></nav><article><p>{'Long text of the page. ' * 4}</p>{node(4)}</article><footer>Us</footer></body></html>"
        reader = Reader()
        reader.feed(page)
        reader.end_line()
        assert html_text.main_text(page).split("\n") == reader.lines, page


def test_op3_odd_markup_takes_linear_time():
    attributes = " ".join(f'a{i}="v{i}"' for i in range(10_000))
    for page, expected in [
        (f"<p>hi</p><img {attributes}", "hi"), (f"<p>hi</p><img {attributes}>you", "hi\nyou"), ("<p>hi</p>" + "<a " * 50_000, "hi"), ("hi" + "<a b='" * 50_001, "hi"), ("<p>1 < 2" + "<" * 100_000, "1 < 2" + "<" * 100_000),
        ("<p>hi" + "<b>" * 30_000 + "</i>" * 30_000, "hi"), ("<p>hi<!--" + "<!--" * 50_000, "hi"), ("<p>hi" + "<script>" * 50_000, "hi"), ("<p>it's <b>bold's</b></p><p title='x>y'>so</p>", "it's bold's\nso"), ("<p>hi</p><p class=\"x>y", "hi\ny"),
    ]:
        begun = time.time()
        assert html_text.main_text(page) == expected and time.time() - begun < 1


def test_op3_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, text string"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "u", "<p>x</p>", "t")] * 2 + [(None, None, None, None)], schema)
    assert sorted(map(tuple, html_text.extract(twice).collect()), key=repr) == sorted([(1, "u", "x", 1)] * 2 + [(None, None, "", 0)], key=repr)


def test_op3_no_cut_or_drop_on_unmarked_pages():
    long, short = "This is the text of the page. " * 5, "Short one."
    menu = "<nav>" + "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(9)) + "</nav>"
    linked = "<p><a href=/x>A paragraph that is a link and nothing else</a></p>"
    page = f"<body>{menu}<h1>{short}</h1><p>{long}</p>{linked}<p>{short}</p><div class=ad>{long * 5}</div><p>{short}</p><p>{long}</p><p>{short}</p>{menu}<footer>Us</footer></body>"
    assert html_text.main_text(page).split("\n") == [short, long.strip(), "A paragraph that is a link and nothing else", short, short, long.strip(), short]


def test_op3_windows_decide_where_a_page_marks_nothing():
    long = "<p>" + "A sentence of the article that is long enough to count. " * 3 + "</p>"
    links = "".join(f"<p><a href='/{i}'>Link {i}</a></p>" for i in range(6))
    page = f"<body><p>Home</p><p>About</p>{links}{long}<p>Short.</p>{long}{links}<p>Imprint</p></body>"
    text = html_text.main_text(page)
    assert text.count("long enough") == 6 and "Short." in text and not any(w in text for w in ("Home", "About", "Link", "Imprint"))


def test_op3_keeps_all_that_is_in_articles_and_takes_linear_time():
    outside = "".join(f"<p>Outside {i}</p>" for i in range(5))
    page = f"<article><p>A note.</p></article>{outside}<article>{'<p>Long text of the second article, with many words in it.</p>' * 4}</article>{outside}<main><p>End.</p></main>"
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "A note." and lines[-1] == "End." and len(lines) == 6
    for name in ("ad", "sidebar"):
        page = "<body>" + "".join(f"<div class='{name}'>buy {i}</div><p>Paragraph {i} with some text in it.</p>" for i in range(20_000)) + "</body>"
        begun = time.time()
        assert html_text.main_text(page).count("\n") == 19_999
        assert time.time() - begun < 15


def test_op4_held_out_accuracy(spark, sf_dir):
    scored = factor_quality.op4_quality_classifier(spark, sf_dir.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    found = scored.where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    assert len(found) > 50 and sum(r.quality == r.predicted for r in found) >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_op4_linear_form_equals_the_sum_over_pairs(docs, spark):
    rng = np.random.default_rng(4)
    machine = factor_quality.Machine(0.1, rng.normal(size=factor_quality.SIZE).astype(np.float32), rng.normal(size=(factor_quality.SIZE, 8)).astype(np.float32))
    row, feature, value = factor_quality.features([b"a b c a", b"", b"d"])
    for i, z in enumerate(machine.logits(row, feature, value, 3)):
        at, x = feature[row == i], value[row == i].astype(float)
        pairs = sum(machine.factor[at[p]].astype(float) @ machine.factor[at[q]].astype(float) * x[p] * x[q] for p in range(len(at)) for q in range(p))
        assert abs(z - (0.1 + machine.weight[at].astype(float) @ x + pairs)) < 1e-2
    empty = factor_quality.learn(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int"))
    assert factor_quality.score(docs, empty).count() == docs.count()


def test_op5_rules_and_model(spark):
    urls = ["http://a.EXAMPLE.net/en/x?y#z", "https://example.net/fr/", "http://www.example.com/de/1", "http://blog.x.org/fr/q", "http://cheap-pills.example.com/en/9", "http://therin.example.com/en/5", None, "no scheme", "http://net", "http://x.net/://y/en/", "https://anet/en/"]
    got = {r.url: r for r in url_filter.judge_urls(spark.createDataFrame([(u, 1) for u in urls], "url string, rule int"), url_filter.labelled_urls(spark)).collect()}
    shown = lambda u: (got[u].host, got[u].path, got[u].rule, got[u].verdict)
    assert shown(urls[0]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert shown(urls[1]) == ("example.net", "/fr/", "net/", "block")
    assert shown(urls[2]) == ("www.example.com", "/de/1", "example.com/de/", "block")
    assert shown(urls[3]) == ("blog.x.org", "/fr/q", "org/fr/", "allow")
    assert shown(urls[4])[2:] == (None, "block") and shown(urls[5])[2:] == (None, "allow")
    assert [(got[u].host, got[u].path, got[u].rule) for u in (None, "no scheme")] == [("", "", None)] * 2
    assert shown(urls[8])[:3] == ("net", "", None) and shown(urls[9])[:3] == ("x.net", "/://y/en/", "net/") and got[urls[10]].rule is None


def test_op6_equals_the_library(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {}
    for i, t in rows:
        ids = library.encode(t or "")
        expected[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), 0)
    assert {r.doc_id: tuple(r)[1:] for r in pieces.encode_and_decode(docs).collect()} == expected


def test_op6_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    path = public_tokenizers.path("piece_bpe_32k.model")
    small, texts = pieces.Codec(path), random_texts(30, 8) + ["😀 ▁ é́"]
    library = small.library
    for i in range(0, 31, 7):
        for t, got in zip(texts[i : i + 7], small.code(texts[i : i + 7]), strict=True):
            assert got[1] == ",".join(map(str, library.encode(t))) and got[3] == 0


def test_op6_long_units(spark):
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    kinds = ("abcdefgh", "aab", "中文字漢語日本", "ABCxyz0123456789+/=", "é😀ßa", "the and ing ".replace(" ", ""), "▁a")
    for n in (65, 100, 1000, 20_000):
        for letters in kinds:
            unit = "".join(rng.choices(letters, k=n))
            assert codec.agenda.alone(pieces.MARK + unit) == codec.agenda.together([pieces.MARK + unit])[0] or n > 1000
            assert codec.code([unit, f"a {unit} b"]) == [(len(x), ",".join(map(str, x)), codec.library.decode(x), 0) for x in codec.library.encode([unit, f"a {unit} b"])]
    begun = time.time()
    unit = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    assert codec.agenda.alone(pieces.MARK + unit) == np.array(codec.library.encode(unit), "<u4").tobytes() and time.time() - begun < 2


def test_op6_empty_table_and_extra_columns(spark):
    odd = spark.createDataFrame([], "doc_id long, text string, n_tokens int")
    assert pieces.encode_and_decode(odd).count() == 0
    rows = pieces.encode_and_decode(spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, None, None)], odd.schema)).collect()
    assert len(rows) == 3 and sorted(r.n_tokens for r in rows) == [0, rows[0].n_tokens or rows[1].n_tokens, max(r.n_tokens for r in rows)]


def test_op7_statistics(docs, rows):
    got = {r.doc_id: r for r in quality_rules.add_stats(docs).collect()}
    for i, t in rows:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count, inside = collections.Counter(windows), set()
        for k, x in enumerate(windows):
            if count[x] > 1:
                inside |= {k, k + 1, k + 2}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == expected


def test_op7_keeps_clean_documents(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.01")
    found = quality_rules.op7_quality_rules(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    assert sum(r.kept == (r.quality == 1) for r in found) >= 0.97 * len(found)


def test_op7_votes_are_numbered():
    cast = np.array(list(itertools.product((-1, 0, 1), repeat=4)))
    assert (quality_rules.votes_of(quality_rules.patterns_of(cast), 4) == cast).all() and len(set(quality_rules.patterns_of(cast))) == 81


def planted_votes(seed, n, chances, shares, abstain=0.1):
    """Votes of texts whose class is known: chances[class][rule] that a vote is a bad one."""
    rng = np.random.default_rng(seed)
    of = rng.choice(len(shares), n, p=shares)
    cast = np.where(rng.random((n, len(chances[0]))) < np.array(chances)[of], -1, 1)
    cast[rng.random(cast.shape) < abstain] = 0
    return of, cast


def test_op7_estimates_planted_accuracies_and_overrules_a_bad_rule():
    classes = ("noisy", "noisy", "noisy", "noisy", "repetitive", "repetitive", "repetitive")
    chances = [[0.01, 0.25, 0.02, 0.03, 0.01, 0.03, 0.02], [0.9, 0.25, 0.8, 0.75, 0.02, 0.02, 0.03], [0.03, 0.25, 0.02, 0.02, 0.85, 0.9, 0.7]]  # the second rule votes at random
    of, cast = planted_votes(1, 40_000, chances, (0.8, 0.12, 0.08))
    rows, inverse, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    good, chance, share = quality_rules.estimate(rows, counts.astype(float), classes)
    assert np.abs(chance - np.array(chances)).max() < 0.05 and np.abs(share - (0.8, 0.12, 0.08)).max() < 0.02
    p = good[inverse.ravel()]
    passes_all = (cast != -1).all(1)
    assert ((p >= 0.5) == (of == 0)).mean() > 0.97 > 0.9 > (passes_all == (of == 0)).mean()
    for low in np.arange(0, 1, 0.2):  # calibrated
        at = (p >= low) & (p <= low + 0.2)
        assert not at.sum() > 500 or abs(p[at].mean() - (of[at] == 0).mean()) < 0.05


def test_op7_estimate_equals_brute_force():
    classes = ("noisy", "repetitive", "noisy")
    _, cast = planted_votes(3, 300, [[0.05, 0.1, 0.1], [0.7, 0.1, 0.6], [0.1, 0.8, 0.1]], (0.7, 0.2, 0.1))
    rows, inverse, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    chance = [[0.5 if c == k else 0.02 for c in classes] for k in ("good", "noisy", "repetitive")]
    share = [0.8, 0.1, 0.1]
    for _ in range(25):  # one text at a time
        bad, votes, weights, p_good = np.zeros((3, 3)), np.zeros((3, 3)), np.zeros(3), []
        for text in cast.tolist():
            odds = []
            for k in range(3):
                x = share[k]
                for j, v in enumerate(text):
                    x *= {-1: chance[k][j], 0: 1.0, 1: 1 - chance[k][j]}[v]
                odds.append(x)
            p_good.append(odds[0] / sum(odds))
            for k in range(3):
                weights[k] += odds[k] / sum(odds)
                for j, v in enumerate(text):
                    bad[k, j] += (v == -1) * odds[k] / sum(odds)
                    votes[k, j] += (v != 0) * odds[k] / sum(odds)
        prior = np.array([[0.5 if c == k else 0.02 for c in classes] for k in ("good", "noisy", "repetitive")])
        share, chance = (weights + 1) / (len(cast) + 3), (bad + 20 * prior) / (votes + 20)
    assert np.allclose(quality_rules.estimate(rows, counts.astype(float), classes, 25)[0][inverse.ravel()], p_good, atol=1e-6)


def test_op7_rows_that_stages_keep(docs, spark):
    more = docs.withColumn("c0", F.lit("x")).withColumn("pattern", F.lit(2))
    stats = {r.doc_id: r.kept for r in quality_rules.judge(quality_rules.add_stats(docs), min_words=1).collect()}
    kept = quality_rules.keep_good(more, min_words=1)
    assert kept.dtypes == more.dtypes and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in stats.items() if k)
    assert quality_rules.keep_good(more.limit(0)).count() == 0


def test_op7_empty(spark):
    assert quality_rules.judge(quality_rules.add_stats(spark.createDataFrame([], DOCS))).count() == 0
    odd = spark.createDataFrame([(1, None, 2), (2, "", 3)], "kept long, text string, n_words int")
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.keep_good(odd).count() == 0


def brute_repeats(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for j in range(len(x) - size + 1):
            if x[j : j + size] in seen:
                gone[j : j + size] = b"\x01" * size
            seen.add(x[j : j + size])
        out[i] = (len(x), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("size", [100, 37, 8])
def test_op8_removes_every_repeat(docs, rows, size):
    marked = repeats.mark_repeats(docs.withColumn("place", F.lit(1)).withColumn("u", F.lit("x")), size)
    assert marked.columns == ["doc_id", "text", "place", "u", "spans"]
    got = {}
    for r in marked.collect():
        text = (r.text or "").encode()
        kept = repeats.kept_bytes(text, [s.asDict() for s in r.spans])
        got[r.doc_id] = (len(text), sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(kept).hexdigest())
    assert got == brute_repeats(rows, size)


def test_op8_small_steps_and_sorts(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "SORT_BYTES", 300)
    texts = [(t or "").encode() for _, t in rows]
    parts = [x for p in repeats.text_segments(texts, 40) for x in zip(*p)]
    monkeypatch.setattr(repeats, "STEP_BYTES", 25)
    small = [x for p in repeats.text_segments(texts, 40) for x in zip(*p)]
    assert sum(p[2] for p in parts) == sum(p[2] for p in small) == sum(max(0, len(t) - 39) for t in texts)
    got = {r.doc_id: sum(s["end"] - s["start"] for s in r.spans) for r in repeats.mark_repeats(docs, 40).collect()}
    assert got == {i: x[1] for i, x in brute_repeats(rows, 40).items()}


def test_op8_null_ids_and_identical_rows(spark):
    text = "0123456789" * 3 + "abcdefghij" * 20
    table = spark.createDataFrame([(None, text), (5, text), (5, text), (6, "é" * 150), (7, "xx" + "é" * 100)], DOCS)
    got = sorted(((r.doc_id, len(r.text or "")) for r in repeats.without_repeats(repeats.mark_repeats(table)).collect()), key=repr)
    assert [n for d, n in got if d == 5] == [0, 0] and (7, 2) in got
    assert repeats.mark_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_op8_cutting_at_once(docs):
    marked = repeats.mark_repeats(docs, 40)
    at_once = repeats.mark_repeats(docs, 40, cut_out=True).drop("spans")
    assert sorted(map(tuple, repeats.without_repeats(marked).collect())) == sorted(map(tuple, at_once.collect()))


@pytest.mark.parametrize("parts", [1, 7])
def test_op8_identical_rows_are_one_document(spark, rows, parts):
    odd = "".join(chr(97 + zlib.crc32(b"%d" % i) % 26) for i in range(400))
    once = [*((i, t) for i, t in rows[:60]), (1001, odd), (1002, odd[:150] + "#" + odd[150:]), (1003, "z" * 150), (1004, odd[50:130] * 2)]
    table = spark.createDataFrame([*once, *once[::2], *once[::3], *once[-4:]], DOCS).repartition(parts)
    expected = brute_repeats(once, 40)
    got = collections.defaultdict(list)
    for r in repeats.mark_repeats(table, 40).collect():
        kept = repeats.kept_bytes((r.text or "").encode(), [s.asDict() for s in r.spans])
        got[r.doc_id].append((len((r.text or "").encode()), sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(kept).hexdigest()))
    assert {i: set(x) for i, x in got.items()} == {i: {x} for i, x in expected.items()}
    assert sum(map(len, got.values())) == table.count() and expected[1001][1] == 0


def test_op8_a_frequent_phrase_is_not_one_group(spark, monkeypatch):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefgh \u00e9", k=n))
    phrase = "All rights reserved, subject to change at any time! 0123"
    texts = [noise(90) + phrase + noise(90) for _ in range(300)]
    texts += [t[: rng.randint(100, 150)] + noise(9) + t[rng.randint(20, 60) :] for t in texts[:80]] + texts[:20] + [texts[5] * 2]
    once = list(enumerate(texts))
    sort, most = repeats.repeated_windows, 40 * 170 + 2 * 5000

    def bounded(text, *others):
        if len(text) > most:
            raise MemoryError(f"{len(text)} bytes in one group")
        return sort(text, *others)

    monkeypatch.setattr(repeats, "SORT_BYTES", 5000)
    monkeypatch.setattr(repeats, "GROUP", 40, raising=False)
    monkeypatch.setattr(repeats, "_DIGESTS", 3000, raising=False)
    monkeypatch.setattr(repeats, "repeated_windows", bounded)
    got = collections.defaultdict(set)
    for r in repeats.mark_repeats(spark.createDataFrame([*once, *once[:50]], DOCS).repartition(5)).collect():
        kept = repeats.kept_bytes(r.text.encode(), [s.asDict() for s in r.spans])
        got[r.doc_id].add((len(r.text.encode()), sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(kept).hexdigest()))
    assert got == {i: {x} for i, x in brute_repeats(once, 100).items()}


def test_op9_round_trip(spark):
    nasty = ["", None, "### user: x</turn>\n### assistant: y", "\\", "\\h \\e \\c", "####", "</turn", "<|image|>", "a: b", "é😀\n"]
    rows = [(c, i, role, t) for c in range(3) for i, (role, t) in enumerate(zip(["user", "assistant", "tool: ###", None, "assistant"] * 2, random.Random(c).sample(nasty, len(nasty))))]
    table = spark.createDataFrame([*rows, (9, 0, "assistant", "x"), (9, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(chat_format.text_turns(table), "conv_id")
    for r in made.collect():
        own = sorted(((t, ro, x) for c, t, ro, x in [*rows, (9, 0, "assistant", "x"), (9, 0, "assistant", "x")] if c == r.conv_id), key=lambda x: x[0])
        assert chat_format.read_turns(r.formatted) == [(ro or "", x or "") for _, ro, x in own]
        assert "".join(chat_format.unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans) == "".join(x or "" for _, ro, x in own if ro == "assistant")


def test_op9_attachments(spark):
    parts = [("text", "See ", None, None), ("image", None, "a.png", 300), ("text", " and ", None, None), ("document", None, "b.pdf", None), ("smell", None, "c", None)]
    chats = spark.createDataFrame([(1, [(0, "user", parts)]), (2, []), (3, None)], f"id long, turns {chat_format.TURNS}")
    got = {r.id: r for r in chat_format.format_chats(chats, "id").collect()}
    assert got[1].formatted == "### user: See <|image|> and <|document|><|document|></turn>\n"
    assert [(a.position, a.kind, a.ref, a.n_tokens) for a in got[1].attachments] == [(0, "image", "a.png", 300), (1, "document", "b.pdf", 512), (2, "document", "c", 512)]
    assert got[1].n_expanded_tokens == 1324 and got[2].formatted == got[3].formatted == ""


def test_op10_equals_sql(spark, duck, sf_dir):
    found = duck.execute(topk.OP10_SQL).fetchall()
    assert sorted(map(tuple, topk.op10_exact_top_k(spark, sf_dir).collect())) == sorted(found)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_op10_ties_nulls_and_blocks(spark, monkeypatch, scale):
    rng = random.Random(6)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    vectors = [(i, [rng.choice([-1.0, 0.25, 0.5]) * scale for _ in range(3)]) for i in range(60)]
    odd = [(100, None), (101, [None, 1.0, 1.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (104, [scale]), (105, [])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    good = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (3 - len(v)) for i, v in [*vectors, odd[5]]}
    expected = set()
    for q in (i for i in good if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:4]
        expected |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(table, 4, F.col("vec_id") % 10 == 0).collect()} == expected


def test_op10_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0]), (50, [1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(few, 5, F.col("vec_id") % 50 == 0).collect()} == {(0, 1, 50, 65536), (50, 1, 0, 65536)}
    assert topk.top_k(few.limit(0), 5, F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="long"):
        topk.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<float>"), 5, F.lit(True))


def test_op8_whole_copies_are_decided_by_backward_extension(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x" + text[500:900])], DOCS).repartition(3)

    def removed():
        return {r.doc_id: sum(s["end"] - s["start"] for s in r.spans) for r in repeats.mark_repeats(docs).collect()}

    assert removed() == {1: 0, 2: 3000, 3: 400}
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(repeats, "repeated_windows", lambda *_: (none, none))
    assert removed()[2] == 0  # third copies of a segment follow the second ones, of which nothing is known here
