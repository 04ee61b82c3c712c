"""Models, tokens, pages, addresses, rules and surrogates."""

import collections
import os
import random
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tavola.llm import html_text, ordinal, pieces, quality_rules, surrogates, toxicity, urls

SYL = ["an", "er", "th", "on", "re", "is", "to", "al"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYL, k=rng.randint(1, 3))) for _ in range(n))


# --- tokens -----------------------------------------------------------------
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer file")


@pytest.fixture(scope="module")
def coder():
    import sentencepiece

    return pieces.Encoder(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@needs_model
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab the\n  \t#éñ日本①😀0x "), st.characters(blacklist_categories=("Cs",))), max_size=60), max_size=4))
def test_tokens_as_the_library(coder, texts):
    own, library = coder
    got = own.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert all(own.decode(x.tolist()) == t for x, t in zip(got, texts, strict=True) if "▁" not in t)


@needs_model
def test_token_rows(spark):
    df = spark.createDataFrame([(1, "the cat", "k"), (1, "the cat", "k"), (None, None, None), (2, "", "e"), (3, "ab " * 50_000, "l")], "doc_id long, text string, ids string").withColumn("_text", F.lit(1))
    out = pieces.encode(df)
    rows = out.collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows) and {r.n_tokens for r in rows if r.doc_id in (None, 2)} == {0}
    assert {r.text for r in pieces.decode(out).collect()} == {"the cat", "", "ab " * 50_000}
    assert pieces.encode(df.limit(0)).count() == 0


@needs_model
def test_long_words_as_the_library(coder):
    import base64

    own, library = coder
    rng = random.Random(2)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x5FFF)) for _ in range(350_000))
    code = base64.b64encode(rng.randbytes(750_000)).decode()
    texts = [cjk, code, "a" * 100_000, "的一是不了在人有我他" * 4000, code[:255], code[:257], " ".join([code[:300]] * 50)]
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)
    assert len(own.known) < 10 or own.chars <= own.most_chars


@needs_model
def test_words_are_forgotten(coder):
    small = pieces.Encoder(most=50, most_chars=2000, long=8)
    rng = random.Random(3)
    for _ in range(20):
        texts = [prose(rng, rng.randint(0, 30)) for _ in range(5)]
        assert [x.tolist() for x in small.encode(texts)] == coder[1].encode(texts)


def test_pairs_of_pieces_table():
    t, rng = pieces._Pairs(most=1 << 12), np.random.default_rng(1)
    t._make(64)
    known = {}
    for _ in range(30):
        codes = np.unique(rng.integers(0, 1 << 40, 40))
        new = codes[t.find(codes) < 0]
        t.add(new, new % 3 == 0)
        known |= {int(c): bool(c % 3 == 0) for c in new}
        at = t.find(codes)
        assert (at >= 0).all() and (t.good[at] == (codes % 3 == 0)).all()


# --- pages --------------------------------------------------------------------
def test_main_text_with_article():
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li>Menu</ul></nav><div class="ad">Buy now</div>
    <article><h1>Head &amp; tail</h1><p>First   long paragraph of&nbsp;text<br>goes on.<p>Second <b>bold paragraph<p>Third</p><div class="comments"><p>I am a comment</p></div>
    <aside>Side</aside><form><p>Name</p></form></article><footer>&copy; x</footer></body></html>"""
    assert html_text.blocks(page) == ["Head & tail", "First long paragraph of text goes on.", "Second bold paragraph", "Third"]


def test_main_text_without_article():
    body = "".join(f"<p>{'A sentence of some length that goes on and on. ' * 4}{i}</p>" for i in range(5))
    page = f"<body><div id='top'><a>Home</a> <a>News</a> <a>About</a></div><ul><li><a>x</a><li><a>y</a></ul><div id='c'><h2>Title</h2>{body}</div><div class='footer'>foot</div><div class='cookie-notice'>We use cookies on this site and need your consent for that</div></body>"
    got = html_text.blocks(page)
    assert got[0] == "Title" and len(got) == 6 and not any("cookies" in x or "Home" in x for x in got)


def test_main_text_of_uneven_paragraphs():
    long, mid, short = "A long sentence. " * 180, "Some more words. " * 25, "And some at the end. " * 15
    nav = "<div id='top'><a>Home</a> <a>News</a> <a>About</a></div><ul><li><a>x</a><li><a>y</a></ul>"
    want = ["T", *[" ".join(x.split()) for x in (long, mid, short)]]
    assert html_text.blocks(f"<body>{nav}<div><h1>T</h1><p>{long}</p><p>{mid}</p><p>{short}</p></div></body>") == want
    assert html_text.blocks(f"<body>{nav}<div><h1>T</h1><div>{long}</div><div>{mid}</div><div>{short}</div></div></body>") == want
    parts = f"<section><h1>T</h1><p>{long}</p></section><section><p>{mid}</p><p>{short}</p></section>"
    assert html_text.blocks(f"<body>{nav}<div>{parts}</div></body>") == want
    ends = f"<h5>Part</h5><p>Hello.</p><ul><li>one</li><li>two</li></ul><p>{long}</p><p>{mid}</p><p>{mid}</p><h4>End</h4><p>Bye.</p><ol><li>three</li></ol>"
    got = html_text.blocks(f"<body>{nav}<div>{ends}<div class='share'>Share</div></div></body>")
    assert got == ["Part", "Hello.", "one", "two", *[" ".join(x.split()) for x in (long, mid, mid)], "End", "Bye.", "three"]
    assert html_text.blocks(f"<p>Hello.</p><p>{long}</p><p>{mid}</p><p>Bye.</p>") == ["Hello.", *want[1:3], "Bye."]


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 2), (3, None, "<p>only text here", 3), (3, None, "<p>only text here", 3), (4, "u", "<!-- <p> " + "x" * 99_999, 4)], "page_id long, url string, html string, text long")
    rows = html_text.extract(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows)[:4] == [(1, "", 0), (2, "", 0), (3, "only text here", 14), (3, "only text here", 14)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_inline_boilerplate_leaves_the_line():
    assert html_text.blocks("<p>Hello <button>Share</button> world <span class='ad'>BUY</span> x<noscript>NO</noscript></p>") == ["Hello world x"]
    assert html_text.blocks("<article><p>Long text <span class='share'>a<p>second</article>") == ["Long text", "second"]
    assert html_text.blocks("<article><p>One <span class='ad'>a <span>b</span> c</span> two <i hidden>x</i>three<p>four</article>") == ["One two three", "four"]
    assert html_text.blocks("<article><p>One</p><span class='ad'><div>BUY</div></span><p>two</p></article>") == ["One", "two"]


def test_links_as_the_standard_library(spark):
    """Every kind of target on every kind of page, against urljoin and the same normal form in plain Python."""
    from urllib.parse import urljoin, urlsplit

    def plain(url):
        u = urlsplit(url)
        own, parts = {"http": ":80", "https": ":443"}.get(u.scheme, ""), []
        path = u.path or "/"
        segments = path.split("/")[1:]
        for x in segments:
            if x == "..":
                parts = parts[:-1]
            elif x != ".":
                parts.append(x)
        if segments[-1] in (".", "..") and parts:
            parts.append("")
        return u.netloc.lower().removesuffix(own) + "/" + "/".join(parts) + (f"?{u.query}" if u.query else "")

    bases = ["http://a.com", "http://a.com/", "https://A.com:443/x/y.html?q=1#f", "http://a.com:80/x/", "http://b.org:8080/p/q/r?s"]
    targets = ["../b/c", "b", "./b/./c", "?p=2", "/r/s", "//Other.net/z", "https://c.de", "http://c.de:80/a/../b", "../../../up", "d/..", "..", ".", "x?y=/../z", "#only", "g;h=1/../i"]
    rows = [(b, t, f"<html><head><link rel='alternate canonical' href='{t}'></head>") for b in bases for t in targets]
    got = collections.defaultdict(set)
    for r in urls.alias_edges(spark.createDataFrame([(b, h) for b, _, h in rows], "url string, html string")).collect():
        got[r.a].add(r.b)
    want = collections.defaultdict(set)
    for b, t, _ in rows:
        if plain(b) != (to := plain(urljoin(b, t))):
            want[plain(b)].add(to)
    assert got == want


def test_what_declares_no_alias(spark):
    url = "http://a.com/x"
    none = ["<!-- <link rel=canonical href=http://b.com/> -->", "<!-- <link rel=canonical href=http://b.com/>", "<script>'<link rel=canonical href=http://b.com/>'</script>", "<link rel=canonical href='mailto:x@y'>", "<link rel=canonical href='javascript:void(0)'>", "<link rel='canonical-x' href='http://b.com/'>", "<link rel=alternate href='http://b.com/canonical'>", "<link rel=canonical>", "<meta http-equiv=refresh content='5'>", "<link rel=canonical href='http://a.com:80/y/../x#top'>"]
    some = ["<LINK REL=Canonical HREF=http://b.com/>", "<link href='http://b.com' rel=\"nofollow\tcanonical\">", "<meta content=\"0; URL='http://b.com/'\" http-equiv=Refresh>", "<!-- x --><link rel=canonical href=//b.com/>"]
    frame = lambda html: spark.createDataFrame([(url, h) for h in html], "url string, html string")
    assert urls.alias_edges(frame([*none, None, ""])).collect() == []
    for h in some:
        assert [tuple(r) for r in urls.alias_edges(frame([h])).collect()] == [("a.com/x", "b.com/")], h


def test_names_of_layouts():
    """A class that names a part of a layout takes no article with it; the part itself stays out."""
    long = "This is a long paragraph of text that goes on and on for a while, as articles do. " * 4
    body = f"<h1>T</h1><p>{long}</p><p>{long}</p>"
    want = ["T", long.strip(), long.strip()]
    for page in (
        f"<div class='layout-with-sidebar'>{body}</div>",
        f"<div class='content sidebar-right'><article>{body}</article></div>",
        f"<div class='post comments-open'>{body}</div>",
        f"<div id='search-results-page'>{body}</div>",
        f"<div class='sidebar-layout'><div>{body}</div><div class='sidebar'><p>{long}</p></div></div>",
        f"<article>{body}<div class='comments'><p>{long}</p><p>{long}</p><p>{long}</p></div></article>",
        f"<div><h1>T</h1><p class='share-price'>{long}</p><p class='related-work'>{long}</p><p class='ad'>{long}</p></div>",
    ):
        assert html_text.blocks(page) == want, page


def test_clusters_select_the_region():
    long = "A sentence of some length that goes on and on. " * 4
    plain = "<div><a href=/>Home</a> <a href=/n>News</a></div><div><a href=/x>x</a></div><div><h1>Title</h1><p>Hi.</p>{0}<p>{1}</p><p>Bye.</p></div><div><b>(c)</b> <i>us</i></div>"
    page = plain.format(f"<p>{long}</p>" * 3, long)
    want = ["Title", "Hi.", *[long.strip()] * 4, "Bye."]
    assert html_text.blocks(page) == want  # no name says where the article is
    assert html_text.blocks(f"<nav><p>{long}</p></nav>{page}<footer>{long}</footer><aside><p>{long * 9}</p></aside>") == want
    assert html_text.blocks(f"<article><header><h1>T</h1></header><p>{long}</p><ul><li>a<li>b</ul><div class='comments'><p>{long}{long}</p></div></article>") == ["T", long.strip(), "a", "b"]
    assert html_text.blocks(f"<div class='ad'>{long}</div><nav>x</nav>") == []


def test_smoothing_and_threshold_decide(monkeypatch):
    rng = random.Random(3)
    line = lambda: rng.choice(["<p>{}</p>", "<p><b>{}</b></p>", "<p><a href=/>{}</a></p>"]).format(prose(rng, rng.choice([1, 2, 4, 9, 30, 60])))
    pages = ["".join("<div>" + "".join(line() for _ in range(rng.randint(1, 6))) + "</div>" for _ in range(rng.randint(2, 6))) for _ in range(200)]
    got = [html_text.blocks(p) for p in pages]
    monkeypatch.setattr(html_text, "smoothed", lambda x: x)
    assert sum(html_text.blocks(p) != g for p, g in zip(pages, got, strict=True)) > 10
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "threshold", lambda x: 0.0)
    assert sum(html_text.blocks(p) != g for p, g in zip(pages, got, strict=True)) > 10


def test_deep_pages_take_linear_time():
    import time

    for unit in ("<div>a", "<span class=ad>a", "<p>a<b>", "<ul><li>a", "<span class=ad><div>a", "<div><p>a</body></span>"):
        began = time.process_time()
        html_text.main_text(unit * 100_000)
        assert time.process_time() - began < 20, unit


def test_smoothing_and_threshold():
    x = np.array([1.0, 1, 1, 50, 60, 55, 1, 1])
    assert html_text.smoothed(np.ones(5)) == pytest.approx(np.ones(5))
    assert 5 < html_text.threshold(x) < 50


# --- addresses ------------------------------------------------------------------
def test_url_rules_and_aliases(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://A.net/x?q", ""), (2, "https://m.example.net/en/1#top", ""), (3, "https://example.com/de/9", ""), (4, "http://example.com/en/", ""),
        (5, "http://b.org/fr/", ""), (6, None, None), (7, "no address", ""), (8, "http://example.net", ""), (9, "ftp://xnet/", ""),
        (10, "http://z.com/a", link("http://a.net/x?q")), (11, "http://y.com/b", '<META http-equiv="refresh" content="0; url=http://z.com/a">'),
        (12, "http://w.com/", link("http://v.com/")), (13, "http://v.com/#f", link("http://example.net/en/ok")), (14, "https://w.com/?k", link("/")), (10, "http://z.com/a", link("http://a.net/x?q")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == ("", "", None, "allow") == got[7] and got[8] == ("example.net", "", None, "allow") and got[9][2] is None
    assert got[10][2:] == (None, "block") == got[11][2:]  # by their alias
    assert got[12][2:] == (None, "allow") == got[13][2:]  # allowed by an alias
    assert urls.judge_urls(df).count() == 15 and urls.judge_urls(df.limit(0)).count() == 0


# --- quality ------------------------------------------------------------------
def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = [None, "", "a b c d e a b c d e", "x " * 9, "l\nl\n\n\n l"] + ["".join(rng.choice("ab \n#") for _ in range(200)) for _ in range(60)]
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if x.split():
                dup += x in seen
                seen.add(x)
        assert quality_rules.counts(t) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(rep))


def test_binomial_tail():
    import math

    for n, p in ((20, 0.05), (300, 0.01)):
        for k in (0, 1, 5, n):
            assert quality_rules.tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_risk_control(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, 80) + (" ###" * 60 if i % 5 == 0 else ""), "en" if i % 2 else "de", 1) for i in range(3000)] + [(None, None, None, 1), (9000, "", "en", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(3000)], "doc_id long, quality int")
    out = quality_rules.apply_rules(df, labels)
    good = out.where("doc_id < 3000 and doc_id % 5 <> 0")
    assert good.where("not kept").count() <= 0.05 * good.count()
    assert out.where("doc_id < 3000 and doc_id % 5 = 0 and kept").count() == 0
    assert out.where("doc_id is null or doc_id = 9000").where("kept").count() == 0
    none = quality_rules.apply_rules(df, labels.limit(0))
    assert none.where("kept = base_failed").count() == 0


def test_cutoffs_need_evidence(spark):
    rows = [(i, "en", 80, 400, 100 if i < 2 else 0, 0, 0) for i in range(40)]
    m = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality_rules.BASE))
    labels = spark.createDataFrame([(i, int(i >= 2)) for i in range(40)], "doc_id long, quality int")
    assert quality_rules.cutoffs(m, labels) == []  # a holdout of 20 good rows cannot show a risk under a twentieth


def brute_cutoffs(rows, good, part, risk=0.05, delta=0.05):
    """Row by row: rows are (id, stratum, counts by name)."""
    import math

    value = {
        "symbols_per_word": lambda r: r["n_symbols"] / max(r["n_words"], 1), "dup_lines_per_100_words": lambda r: 100 * r["n_dup_lines"] / max(r["n_words"], 1),
        "repeat_share": lambda r: r["n_repeat_words"] / max(r["n_words"], 1), "long_words": lambda r: r["word_chars"] / max(r["n_words"], 1),
        "short_words": lambda r: -r["word_chars"] / max(r["n_words"], 1), "few_words": lambda r: -r["n_words"],
    }
    names = list(quality_rules.RULES)
    grids = {n: sorted(quality_rules.RULES[n][1], reverse=True) for n in names}
    rows = [(i, s, r) for i, s, r in rows if i in good and s is not None and r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]]
    bad = lambda r, used: any(value[n](r) > c for n in names for c in grids[n][: used[n]])
    tail = lambda k, n: sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
    strata = sorted({s for _, s, _ in rows})
    strata = [s for s in strata if (1 - risk) ** sum(1 for i, t, _ in rows if t == s and part[i] == 1 and good[i]) <= delta]
    out = []
    for s in strata:
        fit, held = [[(good[i], r) for i, t, r in rows if t == s and part[i] == k] for k in (0, 1)]
        used, taken = dict.fromkeys(names, 0), None
        while True:
            steps = []
            for j, n in enumerate(names):
                for k in range(used[n] + 1, len(grids[n]) + 1):
                    new = [y for y, r in fit if not bad(r, used) and bad(r, used | {n: k})]
                    if new.count(0):
                        steps.append(((new.count(1) + 0.5) / new.count(0), -new.count(0), j, k))
            if not steps:
                break
            _, _, j, k = min(steps)
            used[names[j]] = k
            miss = [bad(r, used) for y, r in held if y]
            if tail(sum(miss), len(miss)) > delta / len(strata):
                break
            taken = dict(used)
        if taken:
            out += [(s, n, float(grids[n][taken[n] - 1])) for n in names if taken[n]]
    return out


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        good, n = int(rng.random() < 0.8), rng.randint(5, 200)
        marks = 0 if good and rng.random() < 0.97 else rng.randint(0, n)
        rows.append((i, rng.choice(["en", "en", "de", None, "xx" if i < 90 else "en"]), n, n * rng.randint(3, 9 if good else 16), marks, rng.randint(0, 3) if rng.random() < 0.3 else 0, rng.randint(0, n // 6), good))
    cols = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality_rules.BASE)
    m = spark.createDataFrame([r[:-1] for r in rows], cols)
    labels = spark.createDataFrame([(r[0], r[-1]) for r in rows if r[0] % 10], "doc_id long, quality int")
    part = {r.doc_id: r.p for r in m.select("doc_id", F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(2)).alias("p")).collect()}
    want = brute_cutoffs([(r[0], r[1], dict(zip(quality_rules.BASE, r[2:7], strict=True))) for r in rows], {r[0]: r[-1] for r in rows if r[0] % 10}, part)
    assert want and quality_rules.cutoffs(m, labels) == want


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "en", 1), (1, long, "en", 1), (2, None, None, 2), (3, "", "en", 3)], "doc_id long, text string, lang string, n_words int")
    got = [(r.doc_id, r.n_words, r.kept) for r in quality_rules.apply_rules(df, labels).collect()]
    assert sorted(got) == [(1, 60_000, True), (1, 60_000, True), (2, 0, False), (3, 0, False)]
    assert quality_rules.apply_rules(df.limit(0), labels).count() == 0


# --- models -------------------------------------------------------------------
def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(3)
    docs = []
    for i in range(700):
        bad = i % 4 == 0
        words = prose(rng, rng.randint(20, 90)).split()
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["zurk", "vlaxa", "zurking", "vlaxon"]))
        docs.append((i, " ".join(words), "en" if i % 3 else "de", int(bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, y int")
    net = toxicity.train(df, df.select("doc_id", F.col("y").alias("toxic")), per_class=400)
    held = toxicity.score(df, net).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.y) for r in held]) > 0.95
    odd = spark.createDataFrame([(1, None, None, 0.0), (2, "", "xx", 0.0), (3, "zurk " + "an er " * 30_000, "en", 0.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in toxicity.score(odd, net).collect()}
    assert got[1].score == got[2].score and 0 <= got[1].score <= 1 and got[3].rejected
    kept = toxicity.without_toxic(odd.withColumn("rejected", F.lit("x")).withColumn("_score", F.lit(1)), net)
    assert kept.columns == [*odd.columns, "rejected", "_score"] and {(r.score, r.rejected, r._score) for r in kept.collect()} == {(0.0, "x", 1)}


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    net = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, net).first().score == pytest.approx(0.5)


def test_long_texts_score_alike():
    rng = random.Random(4)
    net = toxicity.fit([prose(rng, 50) + (" zurk" if i % 2 else "") for i in range(60)], [i % 2 for i in range(60)], epochs=2)
    text = prose(rng, 20_000)
    s = toxicity.Scorer(net)
    assert s.scores([text], most_chars=4000) == pytest.approx(s.scores([text]), abs=1e-5)


def test_scores_are_of_one_text_alone():
    rng = random.Random(6)
    net = toxicity.fit([prose(rng, 30) + (" zurk" if i % 2 else "") for i in range(60)], [i % 2 for i in range(60)], epochs=3)
    texts = ["", None, "zurk", "zurk zurk an", "!?", *[prose(rng, rng.randint(1, 12)) for _ in range(25)]]
    alone = [toxicity.Scorer(net).scores([t])[0] for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert toxicity.Scorer(net).scores([a, b]).tolist() == [alone[i], alone[j]]
    assert toxicity.Scorer(net).scores(texts).tolist() == alone


def test_slices_score_as_the_whole():
    for seed in range(30):
        rng = random.Random(seed)
        net = toxicity.fit([prose(rng, 8) for _ in range(12)], [i % 2 for i in range(12)], epochs=1, n_buckets=512, seed=seed)
        s = toxicity.Scorer(net)
        text = prose(rng, rng.randint(30, 60))
        for chars in (8, 16, 24, 40):
            assert s.scores([text], most_chars=chars).tolist() == s.scores([text]).tolist(), (seed, chars)


def test_fit_reads_no_next_text():
    rng = random.Random(7)
    net = toxicity.fit([prose(rng, 5) for _ in range(8)], [i % 2 for i in range(8)], epochs=1)
    docs = [np.array(x, np.int64) for x in ([1, 2], [], [3, 4, 5], [6])]
    flat, begin, stop = toxicity._layout(docs, max(net.widths))
    for b, e in zip(begin, stop, strict=True):
        assert not flat[e - 1 : e - 1 + max(net.widths)].any()  # all that the last position in the maximum reads


def brute_score(net, text):
    """One text, word by word, place by place."""
    words = re.findall(r"\w+", (text or "").lower())
    vec = []
    for w in words:
        ids, _ = toxicity.buckets([w], len(net.emb))
        vec.append([sum(float(net.emb[i][d]) for i in ids) / len(ids) ** 0.5 for d in range(net.emb.shape[1])])
    f, total = net.bias.size // len(net.conv), net.out_bias
    for n, w in enumerate(net.widths):
        for k in range(f):
            best = 0.0
            for p in range(len(vec)):
                z = sum(vec[p + j][d] * float(net.conv[w][j][d][k]) for j in range(w) if p + j < len(vec) for d in range(len(vec[0])))
                best = max(best, z)
            total += max(best + float(net.bias[n * f + k]), 0.0) * float(net.out[n * f + k])
    return 1 / (1 + np.exp(-total))


def test_toxicity_against_plain_loops():
    rng = random.Random(12)
    net = toxicity.fit([prose(rng, 20) + (" zurk" if i % 2 else "") for i in range(40)], [i % 2 for i in range(40)], epochs=3, n_buckets=1 << 10)
    texts = ["", None, "zurk", "an ER-th", *[prose(rng, rng.randint(1, 25)) for _ in range(12)]]
    assert toxicity.Scorer(net).scores(texts) == pytest.approx([brute_score(net, t) for t in texts], abs=1e-4)


def test_toxicity_of_odd_tables(spark):
    rows = [(i % 40, f"{'zurk' if i % 2 else 'fine'} word{i % 40}", "en") for i in range(400)]  # every id ten times
    df = spark.createDataFrame([*rows, (None, "zurk", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(40)], (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda texts, y, **k: seen.append((len(texts), sum(y))) or fit(texts, y, **k)
    try:
        net = toxicity.train(df, labels)
    finally:
        toxicity.fit = fit
    assert seen[0][0] <= 40 and toxicity.score(df, net).count() == 401
    assert toxicity.score(df.limit(0), net).count() == 0
    empty = toxicity.train(df.limit(0), labels)
    assert toxicity.score(df.limit(1), empty).first().score == pytest.approx(0.5)


def brute_tails(model, text):
    """One text, feature by feature."""
    import zlib

    n, words = len(model.weights), (text or "").split()
    share = collections.Counter()
    for w in words:
        share[zlib.crc32(b"w" + w.lower().encode()) % n] += 1
        share[zlib.crc32(b"s" + ordinal.shape_of(w).encode()) % n] += 2
    m = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    bins = {"n": min(12, len(words).bit_length()), "u": round(10 * len(set(words)) / m), "r": round(20 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / m), "d": round(10 * (1 - len(set(lines)) / max(1, len(lines)))), "c": min(15, len(text or "") // m)}
    s = sum((c / m) ** 0.5 * model.weights[b] for b, c in share.items()) + sum(0.5**0.5 * model.weights[zlib.crc32(f"b{k}{v}".encode()) % n] for k, v in bins.items())
    return [1 / (1 + np.exp(-(s - c))) for c in model.cuts]


def test_ordinal_against_plain_loops():
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(0, 40)) + rng.choice(["", " ###", "\nA1\nA1", " x x"]) for _ in range(80)]
    model = ordinal.fit(texts, [i % 3 for i in range(80)], epochs=2, n_buckets=1 << 16)
    odd = [*texts, None, "", "a"]
    assert ordinal.tails(model, odd) == pytest.approx(np.array([brute_tails(model, t) for t in odd]), abs=1e-9)


def test_ordinal_likelihood_has_this_gradient():
    """One step of the fit from zero weights goes down the likelihood that finite differences give."""
    texts, y = ["aa bb", "cc dd", "aa cc", "bb"], [0, 2, 1, 0]
    loss = lambda m: -sum(np.log(np.r_[1.0, t, 0.0][g] - np.r_[1.0, t, 0.0][g + 1]) for t, g in zip(ordinal.tails(m, texts), y, strict=True))
    before = ordinal.fit(texts, y, epochs=0, n_buckets=512)
    after = ordinal.fit(texts, y, epochs=1, n_buckets=512, batch=4)
    step = after.weights - before.weights
    for b in np.flatnonzero(step)[:6]:
        up = ordinal.Ordinal(before.weights + 1e-4 * (np.arange(512) == b), before.cuts)
        assert (loss(up) - loss(before)) * step[b] < 0


def test_ordinal_of_odd_tables(spark):
    rows = [(i % 30, f"{'good' if i % 3 else 'bad'} text {i % 30}") for i in range(300)]
    df = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string")
    ratings = spark.createDataFrame([*[(i, min(2, i % 3)) for i in range(30)], (None, 1), (2, 7)], "doc_id long, grade int")
    seen = []
    fit = ordinal.fit
    ordinal.fit = lambda texts, grades, n: seen.append(len(texts)) or fit(texts, grades, n)
    try:
        model = ordinal.train(df, ratings)
    finally:
        ordinal.fit = fit
    held = df.select("doc_id").distinct().where("doc_id is not null").where(ordinal.held_out()).count()
    assert seen == [30 - held] and 0 < held < 30
    assert ordinal.grade(df.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "good text " * 60_000)], "doc_id long, text string")
    assert 0 <= ordinal.grade(long, model).first().expected_grade <= 2
    assert len(set(ordinal.train(df.limit(0), ratings).weights)) == 1


def test_ordinal_grades(spark):
    rng = random.Random(5)
    words = {0: "junk ###", 1: "plain", 2: "superb"}
    docs = [(i, prose(rng, 40) + f" {words[i % 3]} {words[i % 3]}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = ordinal.train(df, spark.createDataFrame([(i, i % 3) for i in range(600)], "doc_id long, grade int"), rows=400)
    assert list(model.cuts) == sorted(model.cuts)
    rows = ordinal.grade(df, model).collect()
    mean = [np.mean([r.expected_grade for r in rows if r.doc_id % 3 == g]) for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.4 < mean[2]
    assert all(r.p_above[0] >= r.p_above[1] for r in rows)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2)], "doc_id long, text string, selected int")
    assert len({r.expected_grade for r in ordinal.grade(odd, model).collect()}) == 1
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, None), (3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in ordinal.graded(labels).collect()} == {(1, 0), (2, 1), (3, 0)}


def test_ordinal_gradient_direction():
    model = ordinal.fit(["good"] * 50 + ["bad"] * 50, [1] * 50 + [0] * 50, n_grades=2)
    good, bad = ordinal.tails(model, ["good", "bad"])
    assert good[0] > 0.6 > 0.4 > bad[0]


# --- surrogates -----------------------------------------------------------------
KEY = b"k" * 32


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 9), min_size=1, max_size=4), st.text(max_size=3))
def test_permutation_is_one_to_one(radix, tweak):
    import itertools

    every = list(itertools.product(*[range(r) for r in radix]))
    assert len({tuple(surrogates.permute(list(v), radix, KEY, tweak)) for v in every}) == len(every)


def test_types_and_formats():
    text = "Mail JOHN.doe@Mail3.example.com or john.DOE@mail3.example.com; +1 (487) 555-7209, 487-555-7209; 4845168114407329; 9807915762804490; 10.0.0.7 and 97.51.17.173; IBAN DE89 3704 0044 0532 0130 00; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"."
    kinds = [k for _, _, k in surrogates.find(text)]
    assert collections.Counter(kinds) == {"email": 2, "phone": 2, "card": 1, "ip": 2, "iban": 1, "secret": 1}
    new, n = surrogates.replace(text, KEY)
    assert n == 9 and "9807915762804490" in new and "4845168114407329" not in new and len(new) >= len(text) - 12
    a, b = re.findall(r"\S+@[\w.]+", new)
    assert a.rstrip(";").lower() == b.rstrip(";").lower() and a[:4].isupper() and a.endswith(".com")
    p, q = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", new)[0], re.findall(r"(?<![\d(])(\d{3})-(\d{3})-(\d{4})", new)[-1]
    assert p == q
    card = re.search(r"(?<!\d)4\d{15}(?!\d)", new)[0]
    assert surrogates.luhn(card) and new.count("10.0.") == 1
    iban = re.search(r"DE[\d ]+", new)[0].replace(" ", "")
    assert surrogates._mod97(iban[:22]) == 1


def test_names_keep_script_gender_and_reference():
    new, n = surrogates.replace("Frau Anna Müller kam. Müller ging. г-жа Иванова, Mr. Smith", KEY)
    m = re.fullmatch(r"Frau (\w+a) (\w{6}) kam\. (\w{6}) ging\. г-жа ([А-Я][а-я]+а), Mr\. ([A-Z][a-z]{4})", new)
    assert m and m[2] == m[3] and m[1] != "Anna" and n == 5


def test_distinct_over_the_corpus(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices("abe", k=2)).capitalize() for _ in range(30)]  # a tiny domain, so that surrogates meet entities
    rows = [(i, f"Mr. {n} called {rng.randrange(200, 999)}-555-{rng.randrange(9999):04d}", i) for i, n in enumerate(names)] + [(99, None, 1), (99, "", 1), (98, "plain", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities long")
    out = {r.doc_id: r for r in surrogates.pseudonymize(df, "key").where("doc_id < 90").collect()}
    was = {i: re.match(r"Mr\. (\w+) called (\S+)", t).groups() for i, t, _ in rows if i < 90}
    now = {i: re.match(r"Mr\. (\w+) called (\S+)", r.text).groups() for i, r in out.items()}
    for part in (0, 1):
        pairs = {(was[i][part], now[i][part]) for i in was}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        assert not {a for a, _ in pairs} & {b for _, b in pairs}
    assert surrogates.pseudonymize(df, "key").count() == len(rows) and surrogates.pseudonymize(df.limit(0), "key").count() == 0
    other = surrogates.pseudonymize(df, "another").where("doc_id = 0").first().text
    assert other != out[0].text


def test_what_cannot_move_is_no_entity():
    for text in ("password: ********", "secret = --------", "Mr. 王伟"):
        new, n = surrogates.replace(text, KEY)
        assert (new, n) == (text, 0) if "*" in text or "-" in text else n == 1 and new != text and len(new) == len(text)


def test_scripts_stay():
    import unicodedata

    for name in ("王伟", "김철수", "אברהם", "محمد", "राम"):
        text = f"Mr. {name} und Dr. {name}"
        new, n = surrogates.replace(text, KEY)
        if n:
            found = re.match(r"Mr\. (\S+) und Dr\. (\S+)", new).groups()
            assert found[0] == found[1] != name and [unicodedata.name(c).split()[0] for c in found[0]] == [unicodedata.name(c).split()[0] for c in name]


def test_spellings_of_one_phone():
    text = "+14875557209, +1 487 555 7209, +1 (487) 555-7209, 487-555-7209; +49 (0)30 123456, +49 30 123456"
    assert [surrogates.canonical(k, text[a:b]) for a, b, k in surrogates.find(text)] == ["4875557209"] * 4 + ["30123456"] * 2
    new, _ = surrogates.replace(text, KEY)
    assert len({surrogates.canonical(k, new[a:b]) for a, b, k in surrogates.find(new)}) == 2 and new.startswith("+1") and "+49 (0)" in new


def test_gender_from_titles(spark):
    rows = [(1, "Frau Carmen Vogel"), (2, "Dr. Carmen Vogel"), (3, "Mr. Luca Berg"), (4, "Frau Kim Rohr"), (5, "Herr Kim Stein")]
    out = {r.doc_id: r.text.split() for r in surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert out[1][1].endswith("a") and out[1][1:] == out[2][1:] and out[1][1] != "Carmen"  # one surrogate in all texts, of the gender that one tells
    assert out[3][1][-1] in "nrlsdkot" and out[4][1] == out[5][1]  # told both: nothing


def test_a_full_domain_ends(spark):
    """All 65,536 private addresses of one prefix: distinct, none for itself."""
    rows = [(i, " ".join(f"10.0.{i}.{j}" for j in range(256))) for i in range(256)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.text.split() for r in surrogates.pseudonymize(df, "key").collect()}
    flat = [x for i in range(256) for x in out[i]]
    assert len(set(flat)) == 65_536 and all(x.startswith("10.0.") for x in flat)
    assert not any(x == f"10.0.{i}.{j}" for i in range(256) for j, x in enumerate(out[i]))


def test_one_entity_one_surrogate(spark):
    """Against brute force: entities of all texts, before and after, map one to one; the shape of each stays."""
    rng = random.Random(14)
    make = [
        lambda: f"{rng.choice('abc')}{rng.choice('xy')}@{rng.choice(['a.de', 'b.de', 'mail.com'])}", lambda: f"+1 ({rng.randint(200, 203)}) 555-{rng.randint(0, 30):04d}", lambda: f"20{rng.randint(0, 3)}-555-{rng.randint(0, 30):04d}",
        lambda: f"10.0.0.{rng.randint(0, 40)}", lambda: f"97.1.{rng.randint(0, 3)}.{rng.randint(0, 9)}", lambda: "Mr. " + "".join(rng.choices("aeb", k=2)).capitalize(), lambda: f"token={''.join(rng.choices('ab1', k=8))}",
    ]
    texts = [" ; ".join(rng.choice(make)() for _ in range(rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:20])], "doc_id long, text string").repartition(5)
    forward, back = {}, {}
    rows = surrogates.pseudonymize(df, "key").collect()
    assert len(rows) == 320
    for r in rows:
        old, new = surrogates.find(texts[r.doc_id]), surrogates.find(r.text)
        assert r.n_entities == len(old) and [k for _, _, k in old] == [k for _, _, k in new]
        for (a, b, k), (c, d, _) in zip(old, new, strict=True):
            x, y = (k, surrogates.canonical(k, texts[r.doc_id][a:b])), (k, surrogates.canonical(k, r.text[c:d]))
            assert forward.setdefault(x, y) == y and back.setdefault(y, x) == x and x != y
            assert surrogates.shape(*x) == surrogates.shape(*y)


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        surrogates.pseudonymize(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")


def test_finding_takes_linear_time():
    import time

    for text in ("a" * 1_000_000 + "@", "b@c " * 200_000, "Mr. Ab Cd " * 100_000, "x.y@" * 200_000, "1.2.3.4 " * 100_000):
        began = time.process_time()
        surrogates.find(text)
        assert time.process_time() - began < 30


def test_no_entities_no_change():
    text = string.printable.replace("@", "")
    assert surrogates.replace(text, KEY) == (text, 0) and surrogates.replace(None, KEY) == (None, 0)
