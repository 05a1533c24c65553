"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into its text blocks, in page order. The features of a block are its number of words
and its link density, those of the block before and after it, whether it is a heading, and the
region it lies in (an article, furniture of the page, or neither; told from element names and
class, id and role words). A decision tree, grown on the small labelled table BLOCKS, keeps or
drops it. Furniture told from words or from a form gives way to an article or main element inside it
(after the first article of the page only to main, as comments and related articles follow then), a
form to words of an article as well; and an article word of its own on the same element wins. On a
page of which nothing would stay, such furniture is none: word counts and link densities decide.

Defined results: a null or empty html gives the empty text; elements that are never closed end
with their page, but hide nothing (a title, script or the like then ends at the next tag that cannot
be in it; a comment hides the rest); tags without an end are text; a page takes time linear in its
length; character references are decoded once; white space inside a block becomes one
blank, blocks are joined by one; rows that repeat give equal results each; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Element names of HTML, by what they do to text.
HIDDEN = frozenset("noscript template svg math object canvas audio video head select button".split())
RAW = frozenset("script style title textarea iframe".split())
#: Tags that leave a head open; any other one, or text, ends it, as its end tag may be left out.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes script style template title noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form header menu dialog search fieldset address".split())
ARTICLE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id, role and aria-label.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner bio breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright discussion disqus dropdown feedback foot footer form gdpr hidden login masthead menu menubar message modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup privacy promo promotion recommended register related replies reply respond search share sharing shop sidebar signin signup skip skyscraper social sponsor sponsored subscribe subscription taboola tagcloud tags teaser toc toolbar topbar tracking warning widget".split()
)
ARTICLE_WORDS = frozenset("article articlebody body content entry main maincontent post postcontent story text".split())
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
#: What ends a raw element that is never closed.
PAGE_PART = re.compile(r"</?(?:html|head|body)\b", re.I)
FLOW = re.compile(r"</?(?:html|head|body|main|article|section|header|footer|nav|div|p|h[1-6]|ul|ol|table)\b", re.I)
NAMES = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words before a furniture word that say something of the page only ("no-sidebar").
ABOUT = frozenset("no not has have with without hide".split())
#: The last two are furniture by words or by a form alone; the tree takes them as IN_FURNITURE.
NEITHER, IN_ARTICLE, IN_FURNITURE, IN_WORDS, IN_FORM = 0, 1, 2, 3, 4
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "region", "heading")

#: The labelled table. words, link density %, the same of the block before and after, region, heading; 1: main text.
BLOCKS = """
1 100 0 0 1 100 2 0 0
1 100 1 100 9 0 2 0 0
3 100 2 100 3 100 0 0 0
2 100 0 0 2 100 0 0 0
1 100 1 100 12 0 0 0 0
4 100 5 100 30 0 0 0 0
8 0 1 100 10 0 2 0 0
40 0 1 100 12 0 2 0 0
25 0 60 0 3 100 2 0 0
90 0 30 0 80 0 2 0 0
60 2 80 0 45 0 2 0 0
12 30 55 0 0 0 2 0 0
6 0 70 0 0 0 2 0 0
3 0 12 0 40 0 2 1 0
5 0 90 0 22 0 2 1 0
7 0 8 0 55 0 1 1 1
10 0 8 0 7 0 1 1 1
2 0 60 0 50 0 1 1 1
55 0 10 0 40 0 1 0 1
20 0 55 5 3 0 1 0 1
3 0 20 0 90 0 1 0 1
1 0 40 0 35 0 1 0 1
1 0 2 0 6 0 1 0 1
120 4 60 0 80 10 1 0 1
35 20 44 0 18 0 1 0 1
14 45 30 0 25 0 1 0 1
9 0 9 0 8 0 1 0 1
5 0 0 0 4 0 1 0 1
300 1 10 0 8 0 1 0 1
1 0 1 0 1 0 1 0 1
2 0 5 0 3 0 1 0 1
5 0 3 0 2 0 1 0 1
8 0 12 0 1 0 1 0 1
8 12 2 0 2 0 1 0 1
3 0 8 0 0 0 1 0 1
10 0 4 0 5 0 1 0 1
12 0 1 0 3 0 1 0 1
4 0 2 0 30 0 1 0 1
2 0 1 0 0 0 1 0 1
6 0 9 0 2 0 1 1 1
14 7 6 0 4 25 1 0 1
3 33 8 0 4 0 1 0 1
5 20 2 0 1 0 1 0 1
13 0 14 0 5 0 1 0 1
4 25 1 0 2 0 1 0 1
2 0 150 0 1 0 1 0 1
1 0 30 0 4 0 1 0 1
7 0 25 0 6 0 1 0 1
4 100 40 0 5 100 1 0 0
6 100 4 100 5 100 1 0 0
8 95 30 0 6 100 1 0 0
3 100 7 100 4 0 1 0 0
45 0 9 0 60 0 0 0 1
80 3 45 0 12 0 0 0 1
28 10 60 0 40 0 0 0 1
22 0 30 0 30 0 0 0 1
150 8 5 0 3 0 0 0 1
18 0 40 0 50 0 0 0 1
12 0 45 0 38 0 0 0 1
45 0 30 0 5 0 0 0 1
30 0 25 0 4 50 0 0 1
22 0 40 0 3 100 0 0 1
60 0 80 0 0 0 0 0 1
35 4 70 0 8 0 0 0 1
26 0 33 0 2 0 0 0 1
6 0 50 0 42 0 0 0 1
9 5 33 0 29 4 0 0 1
4 0 60 0 44 0 0 1 1
7 0 3 100 52 0 0 1 1
6 0 1 100 35 0 0 1 1
8 0 2 100 1 100 0 1 0
3 0 2 0 4 100 0 1 0
5 0 4 100 3 0 0 0 0
6 0 3 100 2 100 0 0 0
9 0 1 100 4 0 0 0 0
4 0 3 0 6 0 0 0 0
7 60 5 0 4 0 0 0 0
10 70 30 0 8 80 0 0 0
30 75 20 0 25 80 0 0 0
25 90 4 100 10 100 0 0 0
15 50 3 100 6 100 0 0 0
5 0 40 0 2 100 0 0 0
6 20 60 0 0 0 0 0 0
8 0 35 0 3 0 0 0 0
"""


def grown(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, at most, above), or the share of label 1."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            p, q = labels[low].mean(), labels[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return share
    _, f, cut, low = best
    return f, cut, grown(rows[low], labels[low], depth - 1), grown(rows[~low], labels[~low], depth - 1)


def default_tree() -> tuple | float:
    table = np.array([line.split() for line in BLOCKS.strip().splitlines()], float)
    table[:, [1, 3, 5]] /= 100
    return grown(table[:, :-1], table[:, -1])


def kept(tree: tuple | float, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def _words(element: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether attributes have a word of furniture (other than the element's name), one of an article, and one of an article in a name without one of furniture."""
    furniture = article = own = False
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in WORDS.findall(name)]
            bad = any(w in FURNITURE_WORDS and w != element and (i == 0 or words[i - 1] not in ABOUT) for i, w in enumerate(words))
            good = not ARTICLE_WORDS.isdisjoint(words)
            furniture, article = furniture or bad, article or good
            own = own or good and not bad and m[0][:4].lower() != "aria"
    return furniture, article, own


def _region(name: str, attributes: str, region: int, seen: bool = False) -> int:
    """The region inside an element, from its name, attributes, the region around it, and whether the page had an article."""
    if region == IN_FURNITURE:
        return region
    furniture, article, own = _words(name, attributes) if attributes else (False, False, False)
    soft = region in (IN_WORDS, IN_FORM)
    if furniture and name not in ("html", "body", "main") and not own and not (name in ARTICLE and article):
        return IN_FURNITURE if name in FURNITURE and name != "form" else IN_WORDS
    if name in FURNITURE and not (name in ("header", "address") and region == IN_ARTICLE):
        return IN_FURNITURE if name != "form" else region if soft else IN_FORM
    if name in ARTICLE:
        return region if region == IN_WORDS and seen and name != "main" else IN_ARTICLE
    if article and name != "body" and region != IN_WORDS:
        return IN_ARTICLE
    return region


def _tag_end(page: str, at: int, state: dict) -> int:
    """The place after the tag whose attributes begin at a place; there is a > after it. A > in a quoted value does not end it, where the tag ends at all else."""
    k = at
    while not state["simple"]:
        m = STOP.search(page, k)
        if not m:
            state["failed"] += 1
            state["simple"] = state["failed"] > 3
            break
        if m[0] == ">":
            return m.end()
        before = m.start() - 1
        while before >= at and page[before].isspace():
            before -= 1
        k = m.end()
        if before >= at and page[before] == "=" and m[0] not in state["last"]:
            close = page.find(m[0], k)
            if close < 0:
                state["last"].add(m[0])
            else:
                k = close + 1
    return page.find(">", at) + 1


def tokens(page: str):
    """(text, "", "", 0) for text, and (kind, name, attributes, place) for tags, kind <, </ or <> (closed by itself). In time linear in the page."""
    state = {"simple": False, "failed": 0, "last": set()}
    closed: dict[str, bool] = {}
    ends = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
    final = page.rfind(">")
    i, n = 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0 or j > final:
            yield page[i:], "", "", 0
            return
        if j > i:
            yield page[i:j], "", "", 0
        m = NAME.match(page, j + 1)
        if m:
            end = _tag_end(page, m.end(), state)
            name, attributes = m[1].lower(), page[m.end() : end - 1]
            kind = "</" if page[j + 1] == "/" else "<>" if attributes.rstrip().endswith("/") else "<"
            i = end
            if kind == "<" and name in RAW:
                stop = ends[name].search(page, end) if closed.get(name, True) else None
                closed[name] = stop is not None
                stop = stop or (PAGE_PART if name in ("script", "style") else FLOW).search(page, end)
                i = n if stop is None else stop.start() if not closed[name] else stop.end()
            else:
                yield kind, name, attributes, j
        elif page.startswith("<!--", j):
            k = page.find("-->", j + 2)
            i = n if k < 0 else k + 3
        elif page.startswith("<![CDATA[", j):
            i = j + 9
        elif page[j + 1 : j + 2] in ("!", "?"):
            i = page.find(">", j) + 1
        else:
            yield "<", "", "", 0
            i = j + 1


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, region, heading) of the text blocks, in page order."""
    out: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, int, bool]] = []  # name, region around it, whether it hides what it has
    level: list[int] = []  # places of block elements in the stack
    opened: dict[str, int] = {}  # by name, how many are open
    region, hidden, headings, seen = NEITHER, 0, 0, False
    last_end: dict[str, int] = {}
    lower = page.lower()
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n = len(html.unescape("".join(linked)).split())
                out.append((" ".join(words), len(words), min(1.0, n / len(words)), region, int(headings > 0)))
            parts.clear()
            linked.clear()

    def close(at: int) -> None:
        """Ends the elements of the stack from a place on."""
        nonlocal region, hidden, headings
        region = stack[at][1]
        while len(stack) > at:
            name, _, hides = stack.pop()
            opened[name] -= 1
            hidden -= hides
            headings -= name in HEADING
        while level and level[-1] >= at:
            level.pop()

    for kind, name, attributes, place in tokens(page):
        if not name:
            if hidden and stack[-1][0] == "head" and not kind.isspace():
                close(len(stack) - 1)
            if not hidden:
                parts.append(kind)
                if opened.get("a"):
                    linked.append(kind)
            continue
        if stack and stack[-1][0] == "head" and kind != "</" and name not in HEAD_TAGS:
            close(len(stack) - 1)
        if kind == "</":
            if not opened.get(name):
                if name == "p":
                    flush()
                continue
            if name in BLOCK:
                flush()
            at = len(stack) - 1
            while stack[at][0] != name:
                at -= 1
            close(at)
        elif name == "br":
            parts.append(" ")
            linked.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
        else:
            if name in BLOCK:
                flush()
                # a paragraph or list item that was left open ends here
                if level and (stack[level[-1]][0] == "p" or stack[level[-1]][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    close(level[-1])
            if kind == "<":
                hides = name in HIDDEN
                if hides and name != "head":  # one that is never closed hides nothing
                    if name not in last_end:
                        last_end[name] = lower.rfind(f"</{name}")
                    hides = place < last_end[name]
                if name in BLOCK:
                    level.append(len(stack))
                stack.append((name, region, hides))
                opened[name] = opened.get(name, 0) + 1
                hidden += hides
                headings += name in HEADING
                region = _region(name, attributes, region, seen)
                seen = seen or region == IN_ARTICLE
    flush()
    return out


def main_text(page: str | None, tree: tuple | float) -> str:
    found = blocks(page or "")
    edge = ("", 0, 0.0, 0, 0)
    around = [edge, *found, edge]

    def chosen(regions: dict[int, int]) -> list[str]:
        return [b[0] for a, b, c in zip(around, around[1:], around[2:], strict=False) if kept(tree, (b[1], b[2], a[1], a[2], c[1], c[2], regions.get(b[3], b[3]), b[4]))]

    out = chosen({IN_WORDS: IN_FURNITURE, IN_FORM: IN_FURNITURE})
    return " ".join(out or chosen({IN_WORDS: NEITHER, IN_FORM: NEITHER}))


def extracted(pages: DataFrame, tree: tuple | float | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    tree = default_tree() if tree is None else tree

    def run(batches):
        for b in batches:
            texts = [main_text(x, tree) for x in b.column(b.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("page_id")), b.column(b.schema.get_field_index("url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
