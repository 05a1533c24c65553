import html
import random
import re
import time

import pytest

from tesserae.llm import chat_format, html_extract

from .helpers import SF, same

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=1>Home</a></nav></header>
<div class="cookie-notice">We use cookies on this site to make it better for everyone who reads it.</div>
<div id="content"><article><header><h2>Title of it</h2></header><p>First para with <a href="x>y">link</a> in it &amp; more.<p>Second
 one</p><form><label>Name</label><input type=text></form><!-- c --><script>var a = "</p><p>no</p>";</script><p>Third&nbsp;one &lt;b&gt;.</p><section class="comments"><p>I think this is a very long comment by a reader of this page, indeed it is.</p></section></article></div>
<aside><p>Side text that goes on for quite a while and so on and so forth for ever.</p></aside><div class="ad">Buy this thing now, it is very cheap.</div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    tree = html_extract.default_tree()
    assert html_extract.main_text(PAGE, tree) == "Title of it First para with link in it & more. Second one Third one <b>."
    assert html_extract.main_text(None, tree) == html_extract.main_text("", tree) == html_extract.main_text("<p", tree) == ""


LONG = "This sentence is a part of the text that a reader came for, and it goes on for a while. " * 4


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body><article><p>{LONG}</article>",
        f"<html><head><title>x<body><article><p>{LONG}</article>",
        f"<title>x</title><div class='message'><p>{LONG}</p></div>",
        f"<form class='widget'><p>{LONG}</p></form>",
        f"<body><object data=x><div><p>{LONG}</p></div>",
        f"<body><noscript><p>{LONG}</p>",
        f"<body><p title=it's>{LONG}</p><p class=don't>",
        f"<div id=wrap><div class=col><p>{LONG}<p></div></div><div class=menu><a href=1>One</a> <a href=2>Two</a></div>",
        f"<script>var a = 1;<body><div><p>{LONG}</p></div>",
    ],
)
def test_malformed_and_ambiguous_pages(page):
    assert html_extract.main_text(page, html_extract.default_tree()) == LONG.strip()


@pytest.mark.parametrize("part", ["<b>", "<div>", "<b><div></div>", "<a ", "<a '", "<", "<title>", "<a b='\"><p>", "</p>", "<!--", "<script>", "<li><b>", "<x\">"])
def test_time_is_linear_in_the_page(part):
    page = "<b>" * 30_000 + part * 100_000 + ">" + LONG
    started = time.process_time()
    html_extract.main_text(page, html_extract.default_tree())
    assert time.process_time() - started < 4


def test_tree_fits_its_table():
    table = [list(map(float, x.split())) for x in html_extract.BLOCKS.strip().splitlines()]
    tree = html_extract.default_tree()
    right = sum(html_extract.kept(tree, tuple(v / 100 if i in (1, 3, 5) else v for i, v in enumerate(r[:-1]))) == (r[-1] == 1) for r in table)
    assert right >= 0.95 * len(table)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = html_extract.query(spark, SF).collect()
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", PAGE), (2, "u", PAGE), (3, "u", "<p>" + "word " * 200_000)], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as words", "4 as region")
    assert [r.n_chars for r in html_extract.extracted(odd).orderBy("page_id", "n_chars").collect()] == [0, 0, 72, 72, 999_999]
    assert html_extract.extracted(odd.limit(0)).count() == 0


def test_chats_equal_sql(spark):
    assert same(chat_format.query(spark, SF), chat_format.SQL)


def test_snapshots_collapse(spark):
    rows = []
    said = lambda c, turns: rows.extend((c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns))
    said(1, ["hi"])
    said(2, ["hi", "hello"])
    said(3, ["hi", "hello", "how"])
    said(4, ["hi", "hello", "how"])  # the same again
    said(5, ["hi", "hallo"])
    rows += [(6, 0, " USER ", None), (6, 0, " USER ", None), (None, 0, None, "<|im_end|>"), (7, None, "user", ""), (7, 1, "user", "x " * 100_000)]
    random.Random(1).shuffle(rows)
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as key", "2 as pos", "3 as n")
    got = {r.conv_id: r for r in chat_format.rendered(chats).collect()}
    assert {c: (r.n_turns, r.n_copies) for c, r in got.items()} == {3: (3, 2), 5: (2, 1), 7: (2, 1), None: (1, 1)}
    assert got[5].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhallo<|im_end|>\n"
    assert got[None].text == "<|im_start|>unknown\n< |im_end|><|im_end|>\n"
    assert chat_format.rendered(chats.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_collapse_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    chats = {c: [rng.choice("abc") for _ in range(rng.randint(1, 5))] for c in range(40)}
    rows = [(c, i, "user", t) for c, turns in chats.items() for i, t in enumerate(turns)]
    got = {r.conv_id for r in chat_format.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    expected = {c for c, t in chats.items() if not any(len(o) > len(t) and o[: len(t)] == t or o == t and d < c for d, o in chats.items())}
    assert got == expected


def test_open_heads_and_furniture_words_around_articles():
    tree = html_extract.default_tree()
    text = " ".join(f"word{i} of the article that must be kept whole here" for i in range(6))
    p = f"<p>{text}</p>"
    for page in (
        f"<html><head><title>T</title><meta charset=utf-8><body><article>{p}</article>",
        f"<head><link rel=x><script>var a;</script><div class=content>{p}</div>",
        f"<head><title>T</title><a name=top></a>{p}",
        f"<head><title>T</title></head><body><div class='content no-sidebar'>{p}</div>",
        f"<body><div id='page' class='site has-sidebar'><article>{p}</article></div>",
        f"<body><div class='site sidebar'><main>{p}</main></div>",
        f"<body><form id='aspnetForm' action='x'><div id='content'>{p}</div></form>",
        f"<body><form action='x'><article>{p}</article></form>",
    ):
        assert html_extract.main_text(page, tree) == text, page
    rest = f"<div class='comments'><article>{p}</article></div><div class='comment-body'>{p}</div><nav><article>{p}</article></nav>"
    assert html_extract.main_text(f"<body><article>{p}</article>{rest}</body>", tree) == text
    assert html_extract.main_text("<head><title>only</title><meta name=a>", tree) == ""
