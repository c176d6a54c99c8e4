import random
from itertools import combinations

import pytest
from fathomite.llm import html_region as op


def test_region_matches_all_runs():
    rng = random.Random(5)
    for _ in range(200):
        items = [(rng.choice([-3.0, -1.0, 0.5, 2.0]), rng.randint(0, 3)) for _ in range(rng.randint(0, 12))]
        first, last = op.region(items)
        best = max((sum(s * n for s, n in items[i:j]) for i, j in combinations(range(len(items) + 1), 2)), default=0)
        assert sum(s * n for s, n in items[first:last]) == pytest.approx(max(0, best))


def test_labelled_pages_are_found():
    weights = op.trained()
    assert [len(op._truth(p) ^ op._found(p, weights)) for p in op.LABELLED] == [0] * len(op.LABELLED)
    assert sum(len(op._truth(p) ^ op._found(p, weights)) for p in op.built_pages()) == 0


WORDS = "some words of an article that goes on for quite a while and has an end"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("plain text only", "plain text only"),
        (f"<nav><a>A</a><a>B</a></nav><article><h1>T</h1><p>{WORDS}\n\t x<br>y</p></article><footer>f</footer>", f"T\n{WORDS} x y"),
        (f"<article><p>{WORDS} a &amp; b &lt;c&gt; &#233; &am</article>", f"{WORDS} a & b <c> é &am"),
        (f"<article><p>{WORDS}<script>var t='<p>no</p>';</script><style>p{{}}</style><!-- no --></p><div class='ad'>buy</div><p>{WORDS}</p></article>", f"{WORDS}\n{WORDS}"),
        (f"<article><p><b>{WORDS}<br><p>{WORDS}</p></article><foot", f"{WORDS}\n{WORDS}"),
        (f"<nav><article><p>{WORDS}</p></article>", WORDS),
        (f"<article><p>{WORDS} 1 < 2 and 3 > 2</p></article><script>never closed", f"{WORDS} 1 < 2 and 3 > 2"),
        ("İ" * 12 + f"<article><p>{WORDS}</p><SCRIPT>var İ = 'no'</Script ><p>{WORDS} b</p></article>", f"{WORDS}\n{WORDS} b"),
        (f"<html><head><title>T<body><header class=top><a>x</a></header><article><header><h1>{WORDS}</h1></header><p>{WORDS}</p></article>", f"{WORDS}\n{WORDS}"),
        (f"<div class=comments><p>{WORDS}</p></div><article><p>{WORDS} main</p></article>", f"{WORDS} main"),
    ],
)
def test_pages(page, text):
    assert op.extract(page) == text


A, B, C = (f"{w} {WORDS}" for w in ("First", "Second", "Third"))
#: Pages whose markup is not that of the labelled ones.
HELD_OUT = [
    (f"<main><h1>{A}</h1><p>{B}</p><div class='reader-responses'><h2>What readers say</h2><p>{C} I liked it a lot</p></div></main>", f"{A}\n{B}"),
    (f"<div class='site-masthead'><p>The paper of the valley since 1890</p></div><p>{A}</p><p>{B}</p><div id='disqus_thread'><p>{C}</p></div><div class=colophon>Set in type by hand</div>", f"{A}\n{B}"),
    (f"<div class='newsletterCta'><p>Get our letter every morning in your box</p></div><div class='post__body'><p>{A}</p><blockquote>{B}</blockquote></div>", f"{A}\n{B}"),
    (f"<section class='pageContent'><p>{A}</p><aside><p>{C}</p></aside><p>{B} <a href=x>with a link</a> in it</p></section><div role='navigation'><a>One</a><a>Two</a></div>", f"{A}\n{B} with a link in it"),
    (f"<div><a>Home</a> <a>News of the day</a> <a>Sports</a> <a>All</a></div><div><p>{A}</p><p>{B}</p></div><div class='gdpr-overlay'><p>{C}</p></div>", f"{A}\n{B}"),
    (f"<article><div class='breadcrumbs'><a>a</a> / <a>b</a></div><p>{A}</p><div class='sponsored-links'><p>{C}</p></div><p>{B}</p><section class='relatedArticles'><p>{C}</p></section></article>", f"{A}\n{B}"),
]


@pytest.mark.parametrize(("page", "text"), HELD_OUT)
def test_held_out_pages(page, text):
    assert page not in op.LABELLED + op.built_pages()
    assert op.extract(page) == text


def test_extract_by_brute_force():
    """The words that extract keeps are those of the best of all runs, taken over every start and end."""
    weights = op.trained()
    for page, _ in HELD_OUT:
        seen = list(op.tokens(page, weights))
        value = [score * (len(v.split()) if kind == "text" else 1) for kind, v, score, *_ in seen]
        i, j = max(combinations(range(len(seen) + 1), 2), key=lambda r: (round(sum(value[r[0] : r[1]]), 9), r[0] - r[1]))
        words = [w for kind, v, score, *_ in seen[i:j] if kind == "text" and score > 0 for w in v.split()]
        assert op.extract(page).split() == words


def test_time_is_linear():
    import time

    for page in ("<p>" * 200_000, "<" * 200_000, "<nav>" * 100_000 + "</nav>", "<a b='" * 50_000, "&amp;" * 200_000, "<!--" * 100_000, "<script>" * 100_000, "<div>x" * 50_000 + "</div>" * 50_000, "<div>" * 100_000 + "</p>" * 100_000 + "</div>", "<div><p>x</section>" * 50_000 + "</div>" * 50_000):
        began = time.time()
        op.extract(page)
        assert time.time() - began < 10


def test_table(spark):
    rows = [(1, "u", f"<article><p>{WORDS}</p></article>", 0), (None, None, None, 0), (1, "u", f"<article><p>{WORDS}</p></article>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in op.main_texts(pages).collect())
    assert got == [(0, "", "", 0), (1, "u", WORDS, len(WORDS)), (1, "u", WORDS, len(WORDS))]
    assert op.main_texts(pages.limit(0)).count() == 0
