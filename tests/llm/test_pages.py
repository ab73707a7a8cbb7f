import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roundledger.llm import html_extract, url_filter
from roundledger.llm.html_extract import main_text, min_cut

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style>
<script>var t="</p><p>script text</p>";</script></head><body class="article-page">
<header><h1>Site</h1><nav><ul><li><a href="/a">Menu one</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, as every site does. Please accept all of them.</p></div>
<article><header><h1>The  title</h1></header><p>First &amp; foremost, a paragraph of <b>some</b>
length with&nbsp;words.<br>Second line.<p>Unclosed <i>one.<div class="ad">Buy this now, today only,
a long advert with many words in it.</div><p>Short.</p><ul><li>An item of the list.</li></ul>
<form><label>Your name</label><input name="a > b"></form></article>
<aside><p>Related story with quite a number of words in it, really.</p></aside>
<section id="comments"><p>I think this comment is long enough to look like text.</p></section>
<!-- <p>comment</p> --><footer>&copy; us</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE).split("\n\n") == [
        "The title",
        "First & foremost, a paragraph of some length with words. Second line.",
        "Unclosed one.",
        "Short.",
        "An item of the list.",
    ]


@pytest.mark.parametrize(
    "page", ["", None, "<", "<p", "a < b", "<p>" * 3000, "<a href='x", "<script>", "</p></div>", "&#0;"]
)
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


LONG = "A paragraph that is long enough to be taken for the text of this page, whatever stands near it."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=x><body><article><p>{LONG}</p></article></body></html>",
        f"<head><script>a</script><title>T</title><article><p>{LONG}</p></article>",
        f"<head><noscript><link></noscript><meta><title>T</title></head><body><article><p>{LONG}</p></article>",
        *(
            page
            for tag in ("button", "svg", "select", "template", "datalist")
            for page in (
                f"<body><article><{tag}>Menu<p>{LONG}</p></article></body>",
                f"<body><div><{tag}>Menu</div><article><p>{LONG}</p></article></body>",
                f"<body><{tag}>Menu<article><p>{LONG}</p></article><{tag}>x</{tag}></body>",
                f"<body><div><{tag}>Menu</div><article><p>{LONG}</p></article></{tag}></body>",
                f"<body><article><p>{LONG}</p></article><{tag}><b>not</b><p>this</p></{tag}></body>",
            )
        ),
    ],
)
def test_missing_end_tags_of_skipped_elements_lose_no_text(page):
    assert main_text(page) == LONG


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div style="overflow:hidden"><article><p>{LONG}</p></article></div>',
        f'<body><div class="overflow-hidden"><p>{LONG}</p></div>',
        f'<body><div class="content has-sidebar"><p>{LONG}</p></div>',
        f'<body><div class="no-sidebar"><p>{LONG}</p></div>',
        f'<body><div class="site with-header"><p>{LONG}</p></div>',
        f'<html class="no-js ad-free"><body class="popup"><p>{LONG}</p>',
        f'<main data-title="The hidden valley"><p>{LONG}</p></main>',
        f'<article class="legal-news post"><p>{LONG}</p></article>',
        f'<article class="post tag-side category-social"><p>{LONG}</p></article>',
        f'<div class="header-notice"><article class="advert"><p>{LONG}</p></article></div>',
        f'<div id="sidebar-wrapper"><main><p>{LONG}</p></main></div>',
        f'<div hidden="until-found"><p>{LONG}</p></div>',
        f'<div class="mädchenside"><p>{LONG}</p></div>',
        f"<p>{LONG}</p><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul>",
    ],
)
def test_names_of_other_things_lose_no_article(page):
    assert main_text(page) == LONG


@pytest.mark.parametrize(
    "around",
    [
        "<div hidden>", "<div aria-hidden='true'>", "<div style='color:red; display : none'>",
        "<div class=comments><article class=comment>", "<ol class=comment-list><li><article>",
        "<section class='related-posts'><article>", "<div class='siteFooter'>", "<div id=ad_2>",
        "<div class='wide cookie-banner'>", "<div role=complementary>", "<noscript>", "<article class=comment>",
        "<div class=sidebar-content>", "<article><div class=comments>",
    ],
)
def test_boilerplate_is_left_out(around):
    assert main_text(f"<body><article><p>{LONG}</p></article>{around}<p>{LONG}</p><p>{LONG}</p>") == LONG


@pytest.mark.parametrize(
    "inside",
    [
        "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "<object>x=1</object>", "<canvas>x=1</canvas>",
        "<video src=v>x=1</video>", "<audio>x=1</audio>",
        "<math><semantics><mi>x=1</mi><annotation>TeX</annotation></semantics></math>",
    ],
)
def test_formulas_and_fallback_text_stay(inside):
    page = f"<article><p>{LONG}</p><p>So {inside} holds.</p><noscript><p>{LONG}</p></noscript></article>"
    assert main_text(page).split("\n\n") == [LONG, "So x=1 holds.", LONG]


def test_the_cut_decides_short_blocks_by_their_neighbours():
    items = "".join(f"<li>Item {i}</li>" for i in range(3))
    page = f"<body><div><p>{LONG}</p><ul>{items}</ul><p>{LONG}</p></div>"
    scores = [html_extract.content_score(b) for b in html_extract.blocks_of(page)]
    assert [s > 0 for s in scores] == [True, False, False, False, True]
    assert main_text(page).count("Item") == 3


@settings(max_examples=100)
@given(st.text(alphabet="<>/pdiva \"'=!-&;x", max_size=60))
def test_any_markup(page):
    main_text(page)


def test_minimum_cut_equals_all_labellings():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {
            (i, j): rng.uniform(0, 2) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.6
        }

        def cost(labels):
            wrong = sum(abs(s) for s, x in zip(scores, labels) if (s > 0) != x)
            return wrong + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(min_cut(scores, edges)) == pytest.approx(best)


def test_long_pages_take_linear_room():
    page = "<article>" + "".join(f"<p>Paragraph {i} has a few words.</p>" for i in range(20_000))
    assert main_text(page).count("\n\n") == 19_999


def test_extract_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)],
        "page_id long, url string, html string",
    )
    rows = html_extract.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in rows)[:2] == [0, 0]
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == 4
    assert html_extract.extract_pages(pages.limit(0)).collect() == []
    more = pages.selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS _row")
    assert html_extract.extract_pages(more).count() == 4


def plain_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fitting = [
        r
        for r in url_filter.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fitting, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


URLS = [
    "http://a.com/x", "https://WWW.Example.com/en/1", "https://m.example.com/en/2?p=1#f",
    "http://example.com/fr/", "http://x.net/es/1", "http://x.net/fr/2", "http://x.net/en/3",
    "http://x.org/en/", "http://com", "http://com/", "xcom/", None, "", "://", "http://ÄB.com/é",
    "http://notexample.com/en/", "http://a.com?x=/en/", "ftp://a.com#/en/", "http://x.netfr/fr/",
    "http://a.com\n/x", "http://u:p@a.com:80/x", "http://a.com/x", "http://" + "a" * 5000 + ".org/",
]


def test_rules_equal_plain_matching(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain_rule(url)
        got = rows[i]
        assert (got.host, got.path, got.rule) == (host, path, rule)
        assert got.verdict == verdict if verdict else got.verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        bad = i % 2
        slug = "".join(rng.choice("0123456789") for _ in range(25)) if bad else "plain-words"
        rows.append((i, f"http://h{i % 9}.{'blocked' if bad else 'fine'}.tld/{slug}"))
    rules = (url_filter.Rule("block", "blocked.tld", "/"), url_filter.Rule("allow", "fine.tld", "/"))
    rows += [(1000, "http://new.tld/0123456789012345678901234"), (1001, "http://new.tld/plain-words")]
    table = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(table, rules=rules).collect()}
    assert (got[1000], got[1001]) == ("block", "allow")


def test_url_tables_without_labels(spark):
    table = spark.createDataFrame([(1, "http://x.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(table).collect()} == {"allow"}
    assert url_filter.judge_urls(table.limit(0)).collect() == []
    more = table.selectExpr("*", "1 AS host", "2 AS label", "3 AS prediction")
    assert url_filter.judge_urls(more).count() == 2


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    plan = url_filter.judge_urls(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
