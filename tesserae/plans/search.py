"""From a query to ranked results: one scan of the postings, one aggregation, late fetch of texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, holds, lower_ascii, url_index
from ..model import B, DEFAULT_LIMIT, IMAGE_SLOT, IN_KINDS, K1, MAX_LIMIT, OVERFETCH, PAGE_BITS, PAGE_LIMIT, PER_FILE, WEIGHTS
from .query import Probe, Query


@dataclass
class Index:
    """The tables of a corpus."""

    files: DataFrame
    chunks: DataFrame
    postings: DataFrame
    stats: DataFrame
    vocab: DataFrame


def probes(query: Query) -> tuple[list[Probe], list]:
    """All probes in order, and the trees of the positive terms with numbers for leaves."""
    found: list[Probe] = []

    def number(tree):
        if isinstance(tree, Probe):
            found.append(tree)
            return len(found) - 1
        return tree[0], [number(t) for t in tree[1]]

    return found, [number(t.tree()) for t in query.pos] + [number(t.tree()) for t in query.neg]


def _meets(tree, leaf) -> Column:
    if isinstance(tree, int):
        return leaf(tree)
    parts = [_meets(t, leaf) for t in tree[1]]
    return reduce(lambda a, b: a | b if tree[0] == "or" else a & b, parts)


def _token_meets(probe: Probe, slot: int) -> Column:
    last = probe.prefix and slot == len(probe.tokens) - 1
    return F.startswith("term", F.lit(probe.tokens[slot])) if last else F.col("term") == probe.tokens[slot]


def frequencies(postings: DataFrame, found: list[Probe]) -> DataFrame:
    """(rowid, len, f0, f1, ...): the weighted number of matches of each probe in each chunk that has any."""
    slots = [(k, s, _token_meets(p, s)) for k, p in enumerate(found) for s in range(len(p.tokens))]
    scan = postings.where(reduce(lambda a, b: a | b, [c for _, _, c in slots]))
    marked = scan.select("rowid", "len", "col", "pos", F.explode(F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("probe"), F.lit(s).alias("slot"))) for k, s, c in slots]), lambda x: x.isNotNull())).alias("x"))
    longest = max(len(p.tokens) for p in found)
    places = [F.flatten(F.collect_list(F.when(F.col("x.slot") == s, F.col("pos")))).alias(f"p{s}") for s in range(longest)]
    if longest == 1:
        count = marked.groupBy("rowid", "len", "col", F.col("x.probe").alias("probe")).agg(F.sum(F.size("pos")).alias("tf"))
    else:
        size = F.element_at(F.array(*[F.lit(len(p.tokens)) for p in found]), F.col("probe") + 1)
        # the places where a phrase begins: those of each of its words, moved to the first one's, in common
        begins = reduce(lambda at, s: F.when(size > s, F.array_intersect(at, F.transform(f"p{s}", lambda x: x - s))).otherwise(at), range(1, longest), F.col("p0"))
        count = marked.groupBy("rowid", "len", "col", F.col("x.probe").alias("probe")).agg(*places).withColumn("tf", F.size(begins))
    weight = F.element_at(F.array(*[F.lit(WEIGHTS[c]) for c in ("name", "title", "body")]), F.col("col") + 1)
    sums = [F.coalesce(F.sum(F.when(F.col("probe") == k, weight * F.col("tf"))), F.lit(0.0)).alias(f"f{k}") for k in range(len(found))]
    return count.groupBy("rowid", "len").agg(*sums)


def scores(index: Index, query: Query) -> DataFrame:
    """(rowid, score): the chunks that meet the words of the query, by BM25 over all chunks (lower is better)."""
    found, trees = probes(query)
    found = found or [Probe(("",))]
    f = frequencies(index.postings, [p if p.tokens else Probe(("\0",)) for p in found])
    rows = f.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(found))])
    both = f.crossJoin(F.broadcast(rows.crossJoin(index.stats)))  # one row of totals
    hit = lambda k: F.col(f"f{k}") > 0
    pos, neg = trees[: len(query.pos)], trees[len(query.pos) :]
    meets = _meets(("or" if query.any else "and", pos), hit) if pos else F.lit(False)
    for t in neg:
        meets = meets & ~_meets(t, hit)
    used: list[int] = []

    def leaves(t):
        if isinstance(t, int):
            used.append(t)
        else:
            for x in t[1]:
                leaves(x)

    for t in pos:
        leaves(t)

    def part(k: int) -> Column:
        n = F.col(f"n{k}")
        idf = F.log((F.col("n_rows") - n + 0.5) / (n + 0.5))
        norm = K1 * (1 - B + B * F.col("len") / (F.col("total_tokens") / F.col("n_rows")))
        return F.when(idf > 0, idf).otherwise(1e-6) * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + norm)

    total = reduce(lambda a, b: a + b, [part(k) for k in used]) if used else F.lit(0.0)
    return both.where(meets).select("rowid", (-total).alias("score"))


def filters(query: Query, scope: list[str] | None = None) -> Column:
    """The path, extension, kind and scope filters; unknown kinds filter nothing."""
    out = F.lit(True)
    for p in query.paths:
        out = out & holds("path", p)
    for p in query.not_paths:
        out = out & ~holds("path", p)
    if query.exts:
        out = out & reduce(lambda a, b: a | b, [F.endswith(ascii_lower("path"), F.lit("." + lower_ascii(e))) for e in query.exts])
    kinds = [F.col("source") == "ocr" if k == "ocr" else F.col("kind").isin(*IN_KINDS[k]) for k in query.kinds if k == "ocr" or k in IN_KINDS]
    if kinds:
        out = out & reduce(lambda a, b: a | b, kinds)
    return out & F.col("path").isin(*scope) if scope else out


def recency(score: Column, mtime: Column, now_ms: int) -> Column:
    days = F.greatest(F.lit(0), F.lit(now_ms) - mtime) / 86400000.0
    return score * (1 + 0.2 * 30 / (30 + days))


def file_of(rowid: str = "rowid") -> Column:
    return F.shiftright(rowid, PAGE_BITS)


def slot_of(rowid: str = "rowid") -> Column:
    return F.col(rowid).bitwiseAND(PAGE_LIMIT - 1).cast("int")


def pack(file_id: str | Column, page: str | Column) -> Column:
    to = lambda c: F.col(c) if isinstance(c, str) else c
    return F.shiftleft(to(file_id).cast("long"), PAGE_BITS).bitwiseOR(to(page).cast("long"))


def decoded(kind: Column, page: Column) -> tuple[Column, Column]:
    """Page and line of a result from its slot: sections of notes have lines, other files pages."""
    note, image = kind == "text", page >= IMAGE_SLOT
    return F.when(note, 0).otherwise(page), F.when(note & ~image & (page > 0), page - 1).otherwise(0)


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """Rows (path, kind, score, rowid, ...) with place: notes first, then score; limit x 5 rows count, 5 of a file at most, files by their best row."""
    order = [F.col("kind") != "text", F.col("score"), F.col("rowid")]
    top = hits.orderBy(*order).limit(limit * OVERFETCH)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # limit x 5 rows
    of_file = Window.partitionBy("path")
    capped = top.withColumn("in_file", F.row_number().over(of_file.orderBy("rank"))).withColumn("best", F.min("rank").over(of_file)).where(F.col("in_file") <= PER_FILE)
    return capped.withColumn("place", F.row_number().over(Window.orderBy("best", "rank"))).where(F.col("place") <= limit).drop("in_file", "best", "rank")


def policy(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 or limit > MAX_LIMIT else limit


def hits(index: Index, query: Query, now_ms: int, scope: list[str] | None = None) -> DataFrame:
    """All matching chunks with their files, filtered, and scored with recency."""
    found = scores(index, query).withColumn("file_id", file_of())
    met = found.join(index.files.select(F.col("id").alias("file_id"), "path", "kind", "mtime"), "file_id")
    if "ocr" in query.kinds:
        met = met.join(index.chunks.select("rowid", "source"), "rowid")
    return met.where(filters(query, scope)).select("rowid", "path", "kind", recency(F.col("score"), F.col("mtime"), now_ms).alias("score"))


def _shown(top: DataFrame, texts: DataFrame, query: Query, snippets: bool) -> DataFrame:
    """Results from the rows of ranked() and the chunks (rowid, title, source, body)."""
    from ..operators.snippet import snippet_udf

    met = F.broadcast(top).join(texts, "rowid")  # at most limit rows, which is at most 200
    page, line = decoded(F.col("kind"), slot_of())
    found, _ = probes(query)
    body = snippet_udf(found)(F.col("body")) if snippets else F.lit("")
    return met.select("place", "path", "kind", page.cast("int").alias("page"), line.cast("int").alias("line"), "source", body.alias("snippet"), "score", url_index("title").alias("urlIdx"), "rowid").orderBy("place")


def results(index: Index, query: Query, now_ms: int, scope: list[str] | None = None, limit: int = DEFAULT_LIMIT, snippets: bool = True) -> DataFrame:
    """(place, path, kind, page, line, source, snippet, score, urlIdx, rowid): one lazy plan; texts are fetched for the final rows only."""
    texts = index.chunks.select("rowid", "title", "source", "body" if snippets else F.lit("").alias("body"))
    return _shown(ranked(hits(index, query, now_ms, scope), policy(limit)), texts, query, snippets)


def best(index: Index, query: Query, now_ms: int, scope: list[str] | None = None, limit: int = DEFAULT_LIMIT) -> list[Row]:
    """The rows of ranked(), at most 200, on the driver."""
    return ranked(hits(index, query, now_ms, scope), policy(limit)).select("place", "path", "kind", "score", "rowid").orderBy("place").collect()


def fetched(index: Index, query: Query, top: list[Row]) -> DataFrame:
    """The same as results(), for rows of best(): their ids reach the scan of the chunks, which lie in order of them, as values to look for."""
    spark = index.chunks.sparkSession
    wanted = reduce(lambda a, b: a | b, [F.col("rowid") == r.rowid for r in top], F.lit(False))
    texts = index.chunks.where(wanted).select("rowid", "title", "source", "body")
    return _shown(spark.createDataFrame([tuple(r) for r in top], "place int, path string, kind string, score double, rowid bigint"), texts, query, True)
