"""Registered queries over the driver's tables, and their DuckDB SQL.

Scores are rounded to 12 digits, and the time that recency counts from is fixed.
"""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .model import IN_KINDS, KINDS, STOP_WORDS
from .operators import ask, changes, correct, index, migrate, sections
from .plans import search
from .plans.query import Probe, Query, parse
from .sources import extract
from .sources.tables import DAY, HOUR, NOW_MS, corpus, indexed, read, text
from .sources.tables import SQL as CORPUS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---- searching -------------------------------------------------------------------------------------------------

def _probe_sql(k: int, p: Probe) -> str:
    last = len(p.tokens) - 1
    meets = [f"starts_with(t{i}.term, '{t}')" if p.prefix and i == last else f"t{i}.term = '{t}'" for i, t in enumerate(p.tokens)]
    joins = " ".join(f"JOIN tok t{i} ON t{i}.rowid = t0.rowid AND t{i}.col = t0.col AND t{i}.at = t0.at + {i}" for i in range(1, last + 1))
    return f"f{k} AS (SELECT t0.rowid, sum(CASE t0.col WHEN 0 THEN 8.0 WHEN 1 THEN 4.0 ELSE 1.0 END)::DOUBLE AS f FROM tok t0 {joins} WHERE {' AND '.join(meets)} GROUP BY t0.rowid)"


def scores_sql(q: Query) -> str:
    """CTEs up to scored(rowid, score), for a parsed query."""
    found, trees = search.probes(q)

    def meets(t) -> str:
        return f"a{t}.f IS NOT NULL" if isinstance(t, int) else "(" + f" {t[0].upper()} ".join(map(meets, t[1])) + ")"

    def leaves(t) -> list[int]:
        return [t] if isinstance(t, int) else [x for c in t[1] for x in leaves(c)]

    pos, neg = trees[: len(q.pos)], trees[len(q.pos) :]
    where = (" OR " if q.any else " AND ").join(map(meets, pos))
    where = f"({where})" + "".join(f" AND NOT {meets(t)}" for t in neg)
    idf = "(SELECT CASE WHEN ln((n_rows - c + 0.5) / (c + 0.5)) > 0 THEN ln((n_rows - c + 0.5) / (c + 0.5)) ELSE 1e-6 END FROM (SELECT count(*) AS c FROM f{k}), stats)"
    part = "coalesce(" + idf + " * a{k}.f * 2.2 / (a{k}.f + 1.2 * (0.25 + 0.75 * lens.len / (total_tokens / n_rows))), 0.0)"
    total = " + ".join(part.format(k=k) for t in pos for k in leaves(t))
    joins = " ".join(f"LEFT JOIN f{k} a{k} ON a{k}.rowid = lens.rowid" for k in range(len(found)))
    return f"WITH {CORPUS}, {', '.join(_probe_sql(k, p) for k, p in enumerate(found))}, scored AS (SELECT lens.rowid, -({total}) AS score FROM lens CROSS JOIN stats {joins} WHERE {where})"


RECENT = "score * (1 + 0.2 * 30 / (30 + greatest(0, 1700000000000 - mtime) / 86400000.0))"
RANKED = f"""
, met AS (SELECT s.rowid, path, kind, {RECENT} AS score FROM scored s JOIN files ON files.id = s.rowid >> 20 WHERE {{where}}),
top AS (SELECT *, row_number() OVER (ORDER BY kind <> 'text', score, rowid) AS rank FROM met QUALIFY rank <= {{limit}} * 5),
cap AS (SELECT *, min(rank) OVER (PARTITION BY path) AS best FROM top QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank) <= 5),
placed AS (SELECT *, row_number() OVER (ORDER BY best, rank) AS place FROM cap QUALIFY place <= {{limit}})
"""


def _scored(words: str, any_: bool = False):
    q = parse(words)
    q.any = any_

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.scores(indexed(spark, sf_dir), q).select("rowid", F.round("score", 12).alias("score"))

    return run, scores_sql(q) + " SELECT rowid, round(score, 12) AS score FROM scored"


for _name, _words, _any in [
    ("term_prefix_match", "sch", False), ("phrase_match", '"of the"', False), ("phrase_prefix_match", "of-th", False), ("bool_and", "the que", False), ("bool_or", "sch keit whou", True),
    ("bool_not", "the -sch", False), ("bm25_search", "the", False), ("bm25_weighted_columns", "en doc", False), ("bm25_single_letter", "t", False), ("bm25_three_words", 'in "to the" with', False),
]:
    QUERIES[_name], ORACLES[_name] = _scored(_words, _any)


def _where_sql(q: Query) -> str:
    """The filters as SQL."""
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"contains({low('path')}, '{T.lower_ascii(p)}')" for p in q.paths] + [f"NOT contains({low('path')}, '{T.lower_ascii(p)}')" for p in q.not_paths]
    if q.exts:
        out.append("(" + " OR ".join(f"ends_with({low('path')}, '.{e}')" for e in q.exts) + ")")
    kinds = [k for name in q.kinds for k in IN_KINDS.get(name, ())]
    if kinds:
        out.append("kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")")
    return " AND ".join(out) or "true"


def _ranked(words: str, limit: int = 30, scope: list[str] | None = None):
    q = parse(words)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = search.ranked(search.hits(indexed(spark, sf_dir), q, NOW_MS, scope), limit)
        page, line = search.decoded(F.col("kind"), search.slot_of())
        return out.select("place", "path", "kind", page.cast("int").alias("page"), line.cast("int").alias("line"), F.round("score", 12).alias("score"))

    where = _where_sql(q) + (" AND path IN (" + ", ".join(f"'{p}'" for p in scope) + ")" if scope else "")
    sql = scores_sql(q) + RANKED.format(where=where, limit=limit) + " SELECT place, path, kind, CASE WHEN kind = 'text' THEN 0 ELSE (rowid & 1048575)::INT END AS page, 0::INT AS line, round(score, 12) AS score FROM placed"
    return run, sql


for _name, _words, _limit, _scope in [
    ("recency_boost", "thst", 200, None), ("filter_path", "the path:SRC1", 50, None), ("filter_not_path", "the -path:src -path:web", 50, None), ("filter_ext", "the ext:.HTML ext:pdf", 50, None),
    ("filter_kind", "the in:note", 50, None), ("filter_kind_unknown", "the in:nothing", 50, None), ("rank_notes_first", "and", 200, None), ("per_file_cap", "the in:pdf", 50, None),
    ("filter_scope", "the", 30, ["src1/en/doc_1.md", "src2/en/doc_2.md", "web/page_3.html"]), ("search_two_words", "the with", 50, None), ("search_phrase_path", '"of the" path:en', 50, None),
]:
    QUERIES[_name], ORACLES[_name] = _ranked(_words, _limit, _scope)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: parse, match, score, rank, group by file, fetch snippets."""
    return search.results(indexed(spark, sf_dir), parse("the with -sch"), NOW_MS, limit=50).drop("rowid")


@query("search_snippets")
def _snippets(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("tokenize_vocab", f"WITH {CORPUS} SELECT term, count(DISTINCT rowid) AS doc, count(*) AS cnt FROM tok GROUP BY term")
def _vocab(spark, sf_dir):
    return indexed(spark, sf_dir).vocab


@query("postings", f"WITH {CORPUS} SELECT term, t.rowid, col, string_agg(t.at, ',' ORDER BY t.at) AS pos, any_value(len)::INT AS len FROM tok t JOIN lens USING (rowid) GROUP BY term, t.rowid, col")
def _postings(spark, sf_dir):
    return index.postings(corpus(spark, sf_dir)[1]).withColumn("pos", F.array_join(F.transform("pos", lambda x: x.cast("string")), ",")).withColumn("col", F.col("col").cast("int"))


@query("corpus_stats", f"WITH {CORPUS} SELECT n_rows, total_tokens::BIGINT AS total_tokens FROM stats")
def _stats(spark, sf_dir):
    return indexed(spark, sf_dir).stats


@query("vocab_first_letter", f"WITH {CORPUS} SELECT term, count(DISTINCT rowid) AS doc FROM tok WHERE term >= 'q' AND term < 'r' GROUP BY term")
def _first_letter(spark, sf_dir):
    return indexed(spark, sf_dir).vocab.where("term >= 'q' and term < 'r'").select("term", "doc")


WORDS = ["thta", "whith", "nichtt", "pra", "quie", "zzzqqqx"]
VALUES = ", ".join(f"('{w}')" for w in WORDS)


@query(
    "osa_neighbours",
    f"""WITH {CORPUS}, v AS (SELECT term, count(DISTINCT rowid) AS doc FROM tok GROUP BY term), q(word) AS (VALUES {VALUES}),
    near AS (SELECT word, term, doc, (SELECT min(damerau_levenshtein(word, term[1:k])) FROM (SELECT unnest(range(greatest(len(word) - 1, 1), least(len(word) + 1, len(term)) + 1)) AS k)) AS dist
             FROM v JOIN q ON word[1] = term[1] WHERE len(term) >= greatest(len(word) - 1, 1))
    SELECT word, term, dist::INT AS dist, doc, row_number() OVER (PARTITION BY word ORDER BY dist, doc DESC, term)::INT AS rank FROM near WHERE dist <= 1 QUALIFY rank <= 3""",
)
def _neighbours(spark, sf_dir):
    return correct.neighbours(indexed(spark, sf_dir).vocab, spark.createDataFrame([(w,) for w in WORDS], "word string"))


COMPOUNDS = ["thatwith", "thatwit", "zzzzqqqq", "nichtsich", "withqqqqq"]


@query(
    "compound_split",
    f"""WITH {CORPUS}, v AS (SELECT DISTINCT term FROM tok), q(word) AS (VALUES {", ".join(f"('{w}')" for w in COMPOUNDS)}),
    s AS (SELECT word, unnest(range(3, len(word) - 2)) AS i FROM q),
    ok AS (SELECT word, i FROM s WHERE EXISTS (SELECT 1 FROM v WHERE starts_with(term, word[1:i])) AND EXISTS (SELECT 1 FROM v WHERE starts_with(term, word[i + 1:])))
    SELECT word, word[1:min(i)] AS a, word[min(i) + 1:] AS b FROM ok GROUP BY word""",
)
def _compound(spark, sf_dir):
    return correct.exact_splits(indexed(spark, sf_dir).vocab, spark.createDataFrame([(w,) for w in COMPOUNDS], "word string"))


@query("search_corrected")
def _corrected(spark, sf_dir):
    from .engine import Engine

    return Engine.over(indexed(spark, sf_dir), now_ms=NOW_MS).search("whhith thta", limit=50).drop("rowid")


# ---- asking ----------------------------------------------------------------------------------------------------

QUESTION = "What is the thing about thstea that explains nichtig shhawh?"
_asked = parse(QUESTION).keywords(set(STOP_WORDS))
_asked_sql = scores_sql(_asked) + RANKED.format(where="true", limit=6)


@query("ask_sources", _asked_sql + " SELECT place, path, round(score, 12) AS score FROM placed")
def _ask_sources(spark, sf_dir):
    return ask.sources(indexed(spark, sf_dir), QUESTION, NOW_MS).select("place", "path", F.round("score", 12).alias("score"))


@query(
    "ask_prompt",
    _asked_sql
    + f""" SELECT coalesce(string_agg('[' || place || '] (' || path || CASE WHEN kind <> 'text' AND (p.rowid & 1048575) > 0 THEN ', page ' || (p.rowid & 1048575) ELSE '' END || ')' || chr(10) || trim(body[1:1000], ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10), '' ORDER BY place), '') || 'Question: {QUESTION}' AS prompt
    FROM placed p JOIN chunks USING (rowid)""",
)
def _ask_prompt(spark, sf_dir):
    return ask.prompt(indexed(spark, sf_dir), QUESTION, NOW_MS)


@query("ask_keywords", "SELECT w FROM (SELECT unnest(string_split('" + QUESTION + "', ' ')) AS w) WHERE len(w) > 3 AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")")
def _ask_keywords(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in ask.keywords(QUESTION)], "w string")


# ---- notes -----------------------------------------------------------------------------------------------------

NOTE = "'---' || chr(10) || 'tags: [' || lang || ', #' || source || ']' || chr(10) || '---' || chr(10) || text || chr(10) || '# Part of ' || source || ' ##' || chr(10) || 'see #' || lang || '/x and ![p](https://h/' || (doc_id % 7) || '.png)' || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## Rest' || chr(10) || '<img alt=\"a\" src=\"https://g/' || (doc_id % 3) || '.png\"> ![q](https://h/' || (doc_id % 7) || '.png) #end'"


def _notes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(NOTE).alias("text"))


NOTES = f"notes AS (SELECT doc_id, {NOTE} AS text FROM documents)"


@query(
    "markdown_sections",
    rf"""WITH {NOTES}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM notes),
    f AS (SELECT *, sum(CASE WHEN starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') THEN 1 ELSE 0 END) OVER w AS fences FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
    h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+(.*?)[\s#]*$') AND fences % 2 = 0 AND NOT starts_with(trim(line), '```') AS head FROM f),
    p AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY no) AS part FROM h),
    s AS (SELECT doc_id, min(no) + 1 AS page, string_agg(line, chr(10) ORDER BY no) AS body FROM p GROUP BY doc_id, part)
    SELECT doc_id, page::INT AS page, body FROM s WHERE page = 1 OR trim(regexp_replace(body, '\s+', ' ', 'g')) <> ''""",
)
def _sections(spark, sf_dir):
    return sections.sections(_notes(spark, sf_dir), "doc_id").drop("title")


@query(
    "section_titles",
    rf"""WITH {NOTES}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM notes),
    f AS (SELECT *, sum(CASE WHEN starts_with(trim(line), '```') OR starts_with(trim(line), '~~~') THEN 1 ELSE 0 END) OVER w AS fences FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
    h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+(.*?)[\s#]*$') AND fences % 2 = 0 AND NOT starts_with(trim(line), '```') AS head FROM f),
    p AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY no) AS part FROM h),
    s AS (SELECT doc_id, min(no) + 1 AS page, bool_or(head) AS headed, arg_min(line, no) AS first, string_agg(line, chr(10) ORDER BY no) AS body FROM p GROUP BY doc_id, part)
    SELECT doc_id, page::INT AS page, array_to_string(list_filter([CASE WHEN headed THEN regexp_extract(first, '^#{{1,6}}\s+(.*?)[\s#]*$', 1) END, array_to_string(regexp_extract_all(body, '{T.TAG}', 1), ' '), CASE WHEN page = 1 THEN lang || ' ' || source END], lambda x: x IS NOT NULL AND x <> ''), ' ') AS title
    FROM s JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id) WHERE page = 1 OR trim(regexp_replace(body, '\s+', ' ', 'g')) <> ''""",
)
def _section_titles(spark, sf_dir):
    return sections.sections(_notes(spark, sf_dir), "doc_id").drop("body")


@query("inline_tags", rf"WITH {NOTES} SELECT doc_id, array_to_string(regexp_extract_all(text, '{T.TAG}', 1), ' ') AS tags FROM notes")
def _tags(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", F.array_join(T.tags("text"), " ").alias("tags"))


@query("frontmatter_tags", "SELECT doc_id, lang || ' ' || source AS tags FROM documents")
def _front(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", T.frontmatter_tags("text").alias("tags"))


@query("remote_image_urls", "SELECT doc_id, 'https://h/' || (doc_id % 7) || '.png https://g/' || (doc_id % 3) || '.png' AS urls FROM documents")
def _urls(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", F.array_join(F.slice(T.image_urls("text"), 1, 20), " ").alias("urls"))


@query("match_line", "SELECT doc_id, CASE WHEN k > 0 THEN k - 1 ELSE 1 END::INT AS match FROM (SELECT doc_id, list_position([i > 1 AND contains(lower(l[i]), 'tion') FOR i IN range(1, len(l) + 1)], true) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def _match_line(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("line"))
    return sections.match_line(docs, "TION").select("doc_id", "match")


@query("html_text")
def _html(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("web/"), text("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return extract.extracted(pages).select("path", F.explode("pages").alias("p")).select("path", "p.n", "p.body")


# ---- files and paths -------------------------------------------------------------------------------------------

PATHS = "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a/b.c/Doc.' || doc_id || '.MD' WHEN 1 THEN 'img/p' || doc_id || '.png' WHEN 2 THEN '.hid/x' || doc_id || '.md' WHEN 3 THEN 'x/none' || doc_id WHEN 4 THEN 'archive/s.' || doc_id || '.docx' WHEN 5 THEN 'a/.y/z.rtf' WHEN 6 THEN 'rec/' || doc_id || '.m4a' ELSE 'archived/' || doc_id || '.epub' END AS path FROM documents"
KIND_SQL = "CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items()) + " END"


def _paths(spark, sf_dir) -> DataFrame:
    read(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(PATHS)


@query("kind_dispatch", f"SELECT doc_id, path, {KIND_SQL} AS kind, coalesce({KIND_SQL} IN ('image', 'audio'), false) AS slow FROM ({PATHS})")
def _kinds(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", "path", T.kind_of("path").alias("kind")).withColumn("slow", F.coalesce(F.col("kind").isin("image", "audio"), F.lit(False)))


@query("file_stem", rf"SELECT doc_id, CASE WHEN {KIND_SQL} IN ('image', 'audio') THEN '' ELSE regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') END AS stem FROM ({PATHS})")
def _stems(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("kind", T.kind_of("path")).select("doc_id", T.stem("path", "kind").alias("stem"))


@query("scan_filter", f"SELECT doc_id, path FROM ({PATHS}) WHERE NOT regexp_matches(path, '(^|/)\\.') AND NOT (path = 'archive' OR starts_with(path, 'archive/')) AND {KIND_SQL} IS NOT NULL")
def _scan(spark, sf_dir):
    return _paths(spark, sf_dir).where(~T.dotted("path") & ~T.ignored("path", ["archive"]) & T.kind_of("path").isNotNull())


@query("path_validation", f"SELECT doc_id, NOT starts_with(path, '/') AND NOT list_contains([starts_with(p, '.') FOR p IN string_split(path, '/')], true) AS valid FROM ({PATHS})")
def _valid(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", T.valid_path("path").alias("valid"))


@query("rowid_pack_join", f"WITH {CORPUS} SELECT c.rowid, path, c.page FROM chunks c JOIN files ON files.id = c.rowid >> 20")
def _pack_join(spark, sf_dir):
    files, chunks = corpus(spark, sf_dir)
    return chunks.join(files, search.file_of() == F.col("id")).select("rowid", "path", search.slot_of().alias("page"))


@query("rowid_range_join", f"WITH {CORPUS} SELECT DISTINCT path FROM files JOIN chunks ON rowid BETWEEN id << 20 AND ((id + 1) << 20) - 1 WHERE title = 'user'")
def _range_join(spark, sf_dir):
    """A range of row ids is all rows of one file, so the range join is an equality of the upper bits."""
    files, chunks = corpus(spark, sf_dir)
    return files.join(chunks.where("title = 'user'").select(search.file_of().alias("id")), "id", "left_semi").select("path")


@query("short_hashes", f"SELECT doc_id, sha256(path)[1:8] AS key FROM ({PATHS})")
def _hashes(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", T.short_hash("path").alias("key"))


@query("url_index", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 20 ELSE -1 END::INT AS i FROM documents")
def _url_index(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("url:"), text(F.col("doc_id") % 20))).when(F.col("doc_id") % 3 == 1, "url:x").otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", T.url_index(title).alias("i"))


# ---- changes ---------------------------------------------------------------------------------------------------

OLD = f"SELECT doc_id AS id, 'n/' || (doc_id % 20) || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 9 = 0 THEN 'image' ELSE 'text' END AS kind, 1700000000000 - doc_id * {HOUR} AS mtime, n_chars AS size, CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'pending' WHEN 2 THEN 'ocr' ELSE 'done' END AS status, '' AS error FROM documents WHERE doc_id % 10 <> 3"
NEW = f"SELECT 'n/' || (doc_id % 20) || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 9 = 0 THEN 'image' ELSE 'text' END AS kind, 1700000000000 - doc_id * {HOUR} + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS mtime, n_chars AS size FROM documents WHERE doc_id % 10 <> 4"
FEED = "SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, 'n/' || (user_id % 20) || '/' || user_id || '.md' AS path, 'text' AS kind, event_id AS mtime, user_id AS size FROM events"


def _views(spark, sf_dir, *tables: str) -> None:
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)


def _old(spark, sf_dir) -> DataFrame:
    _views(spark, sf_dir, "documents")
    return spark.sql(OLD)


DIFF_SQL = f"SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'delete' WHEN n.kind <> o.kind OR n.mtime <> o.mtime OR n.size <> o.size OR o.status = 'error' THEN 'update' ELSE 'same' END AS op FROM ({NEW}) n FULL JOIN ({OLD}) o ON n.path = o.path"


@query("snapshot_diff", DIFF_SQL)
def _diff(spark, sf_dir):
    return changes.snapshot_diff(spark.sql(NEW) if not _views(spark, sf_dir, "documents") else None, spark.sql(OLD), retry_errors=True).select("path", "op")


@query(
    "files_upsert",
    f"""WITH b AS (SELECT coalesce(n.path, o.path) AS path, n.path IS NOT NULL AND (o.path IS NULL OR n.kind <> o.kind OR n.mtime <> o.mtime OR n.size <> o.size OR o.status = 'error') AS differs, o.id, n.kind AS nk, o.kind AS ok, n.mtime AS nm, o.mtime AS om, o.status FROM ({NEW}) n FULL JOIN ({OLD}) o ON n.path = o.path)
    SELECT path, id IS NULL AS fresh, CASE WHEN differs THEN nk ELSE ok END AS kind, CASE WHEN differs THEN nm ELSE om END AS mtime, CASE WHEN differs THEN CASE WHEN nk IN ('image', 'audio') THEN 'ocr' ELSE 'pending' END ELSE status END AS status FROM b""",
)
def _upsert(spark, sf_dir):
    old = _old(spark, sf_dir)
    most = old.agg(F.max("id").alias("most"))
    return changes.upsert(old, spark.sql(NEW)).crossJoin(F.broadcast(most)).select("path", (F.col("id") > F.col("most")).alias("fresh"), "kind", "mtime", "status")


@query(
    "cdc_apply",
    f"""WITH l AS (SELECT path, arg_max(op, seq) AS op, arg_max(mtime, seq) AS mtime FROM ({FEED}) GROUP BY path)
    SELECT coalesce(l.path, o.path) AS path, coalesce(l.mtime, o.mtime) AS mtime, CASE WHEN l.path IS NULL THEN o.status ELSE 'pending' END AS status FROM l FULL JOIN ({OLD}) o ON l.path = o.path WHERE l.op IS DISTINCT FROM 'delete'""",
)
def _apply(spark, sf_dir):
    _views(spark, sf_dir, "documents", "events")
    return changes.apply(spark.sql(OLD), spark.sql(FEED)).select("path", "mtime", "status")


def _replayed(steps: list[tuple[str, str]]) -> str:
    """SQL for changes and renames in turn: (condition on seq, or the old path; "" or the new path) each. Ends in paths with their times."""
    parts, last = [f"s0 AS (SELECT path, mtime FROM ({OLD}))"], 0
    for k, (a, b) in enumerate(steps, 1):
        if b:
            parts.append(f"s{k} AS (SELECT CASE WHEN path = '{a}' OR starts_with(path, '{a}/') THEN '{b}' || path[{len(a) + 1}:] ELSE path END AS path, mtime FROM s{last} WHERE NOT (path = '{b}' OR starts_with(path, '{b}/')) OR path = '{a}' OR starts_with(path, '{a}/'))")
        else:
            parts.append(f"l{k} AS (SELECT path, arg_max(op, seq) AS op, arg_max(mtime, seq) AS mtime FROM ({FEED}) WHERE {a} GROUP BY path)")
            parts.append(f"s{k} AS (SELECT coalesce(l.path, o.path) AS path, coalesce(l.mtime, o.mtime) AS mtime FROM l{k} l FULL JOIN s{last} o ON l.path = o.path WHERE l.op IS DISTINCT FROM 'delete')")
        last = k
    return f"WITH {', '.join(parts)} SELECT path, mtime FROM s{last}"


RENAMES = [(300, "n/3", "m/q"), (301, "n/5/5.md", "n/6/6.md"), (700, "m/q", "n/4")]


@query("feed_rename_order", _replayed([("seq < 300", ""), ("n/3", "m/q"), ("seq = 300", ""), ("n/5/5.md", "n/6/6.md"), ("seq > 300 AND seq < 700", ""), ("m/q", "n/4"), ("seq >= 700", "")]))
def _rename_order(spark, sf_dir):
    """Changes and renames in one batch, in the order of seq; a rename comes before the change of the same number."""
    _views(spark, sf_dir, "documents", "events")
    feed = spark.sql(f"SELECT seq * 2 + 1 AS seq, op, path, CAST(NULL AS STRING) AS old_path, kind, mtime, size FROM ({FEED})")
    renames = spark.createDataFrame([(s * 2, "rename", new, old, "", 0, 0) for s, old, new in RENAMES], feed.schema)
    return changes.replay(spark.sql(OLD), feed.unionByName(renames)).select("path", "mtime")


@query(
    "feed_folder_delete",
    f"""WITH l AS (SELECT path, arg_max(op, seq) AS op, arg_max(mtime, seq) AS mtime, max(seq) AS seq FROM ({FEED}) GROUP BY path), gone(folder, until) AS (VALUES ('n/3', 400), ('n/5', 900), ('n/7/7.md', 500)),
    b AS (SELECT coalesce(l.path, o.path) AS path, coalesce(l.mtime, o.mtime) AS mtime, coalesce(l.op, 'old') AS op, coalesce(l.seq, -1) AS seq FROM l FULL JOIN ({OLD}) o ON l.path = o.path)
    SELECT path, mtime FROM b WHERE op <> 'delete' AND NOT EXISTS (SELECT 1 FROM gone WHERE (b.path = folder OR starts_with(b.path, folder || '/')) AND until > b.seq)""",
)
def _folder_delete(spark, sf_dir):
    """A delete of a folder takes what is in it then, and not what comes later."""
    _views(spark, sf_dir, "documents", "events")
    feed = spark.sql(f"SELECT seq * 2 AS seq, op, path, kind, mtime, size FROM ({FEED}) UNION ALL SELECT until * 2 - 1, 'delete', folder, NULL, NULL, NULL FROM VALUES ('n/3', 400), ('n/5', 900), ('n/7/7.md', 500) AS g(folder, until)")
    return changes.apply(spark.sql(OLD), feed).select("path", "mtime")


@query("subtree_delete", f"SELECT id, path FROM ({OLD}) WHERE NOT (path = 'n/3' OR starts_with(path, 'n/3/') OR path = 'n/1/1.md' OR starts_with(path, 'n/1/1.md/'))")
def _delete(spark, sf_dir):
    return changes.remove(_old(spark, sf_dir), ["n/3", "n/1/1.md"]).select("id", "path")


@query("rename_apply", f"SELECT id, CASE WHEN starts_with(path, 'n/3/') THEN 'm/q/' || path[5:] ELSE path END AS path FROM ({OLD})")
def _rename(spark, sf_dir):
    return changes.rename(_old(spark, sf_dir), "n/3", "m/q").select("id", "path")


@query("stale_guard", f"SELECT o.id FROM ({OLD}) o JOIN ({NEW}) n ON o.path = n.path AND o.mtime = n.mtime AND o.size = n.size")
def _guard(spark, sf_dir):
    jobs = _old(spark, sf_dir).select("id", "path", "mtime", "size")
    return jobs.join(spark.sql(NEW).select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi").select("id")


@query("status_counts", f"SELECT s.status, count(o.id) AS n FROM (VALUES ('pending'), ('ocr'), ('done'), ('error')) s(status) LEFT JOIN ({OLD}) o ON o.status = s.status GROUP BY s.status")
def _status(spark, sf_dir):
    return changes.status_counts(_old(spark, sf_dir))


@query("queue_next", f"SELECT id, path FROM ({OLD}) WHERE status = 'pending' AND id NOT IN (1, 11) ORDER BY id LIMIT 3")
def _next(spark, sf_dir):
    return changes.next_jobs(_old(spark, sf_dir), "pending", [1, 11], 3).select("id", "path")


@query("config_requeue", f"SELECT id, CASE WHEN kind IN ('image', 'audio') THEN 'ocr' ELSE status END AS status FROM ({OLD})")
def _requeue(spark, sf_dir):
    return changes.requeue_media(_old(spark, sf_dir), "en-US", "hi-IN").select("id", "status")


# ---- remote images and links -----------------------------------------------------------------------------------

def _note_urls(spark, sf_dir) -> DataFrame:
    return _notes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.explode(F.slice(T.image_urls("text"), 1, 20)).alias("url"))


URLS = "urls AS (SELECT doc_id AS id, unnest(['https://h/' || (doc_id % 7) || '.png', 'https://g/' || (doc_id % 3) || '.png']) AS url FROM documents)"
MEMO = "SELECT DISTINCT 'https://h/' || (doc_id % 7) || '.png' AS url, 'seen ' || (doc_id % 7) AS body FROM documents WHERE doc_id % 7 < 4"


@query("memo_antijoin", f"WITH {URLS} SELECT DISTINCT url FROM urls WHERE url NOT IN (SELECT url FROM ({MEMO}))")
def _memo(spark, sf_dir):
    _views(spark, sf_dir, "documents")
    return changes.missing_urls(_note_urls(spark, sf_dir), spark.sql(MEMO))


@query("backlog_distinct_urls", f"WITH {URLS} SELECT count(DISTINCT url) AS n FROM urls WHERE id % 11 = 5 AND url NOT IN (SELECT url FROM ({MEMO}))")
def _backlog(spark, sf_dir):
    _views(spark, sf_dir, "documents")
    queued = read(spark, sf_dir, "documents").where("doc_id % 11 = 5").select(F.col("doc_id").alias("id"))
    return changes.backlog(queued, _note_urls(spark, sf_dir), spark.sql(MEMO))


@query("memo_remember", "SELECT 'https://h/' || k || '.png' AS url, CASE WHEN k IN (2, 5) THEN 'new ' || k ELSE 'seen ' || k END AS body FROM (VALUES (0), (1), (2), (3), (5)) v(k)")
def _remember(spark, sf_dir):
    _views(spark, sf_dir, "documents")
    found = spark.sql("SELECT DISTINCT 'https://h/' || (doc_id % 7) || '.png' AS url, CASE WHEN doc_id % 7 = 6 THEN '' ELSE 'new ' || (doc_id % 7) END AS body FROM documents WHERE doc_id % 7 IN (2, 5, 6)")
    return changes.remember(spark.sql(MEMO), found)


@query("image_chunks", f"WITH {URLS} SELECT id * 1048576 + 262144 + i - 1 AS rowid, 'url:' || (i - 1) AS title, m.body FROM (SELECT id, url, row_number() OVER (PARTITION BY id ORDER BY url DESC) AS i FROM urls) u JOIN ({MEMO}) m USING (url)")
def _image_chunks(spark, sf_dir):
    """The chunks of a note's remote images: numbered by first occurrence, with remembered texts."""
    _views(spark, sf_dir, "documents")
    numbered = _notes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.posexplode(F.slice(T.image_urls("text"), 1, 20)).alias("i", "url"))
    return numbered.join(spark.sql(MEMO), "url").select(search.pack("id", F.lit(0x40000) + F.col("i")).alias("rowid"), F.concat(F.lit("url:"), text("i")).alias("title"), "body")


EMBEDS = "SELECT 'n/' || o_custkey || '.md' AS note, o_orderkey AS ord, 'img/' || (o_orderkey % 500) || '.png' AS dest FROM orders"


@query("first_embedding_note", f"SELECT dest, arg_min(note, ord) AS note FROM ({EMBEDS}) GROUP BY dest")
def _first_note(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    return changes.first_notes(spark.sql(EMBEDS))


@query("note_scope", f"SELECT DISTINCT dest AS path FROM ({EMBEDS}) WHERE note = 'n/7.md' UNION SELECT 'n/7.md'")
def _scope(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    return changes.scope_of(spark.sql(EMBEDS), "n/7.md")


@query(
    "embed_lines",
    rf"""WITH {NOTES}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS words, unnest(range(len(string_split(text, chr(10))))) AS line FROM notes),
    each AS (SELECT doc_id, line, unnest(regexp_extract_all(words, 'https://[hg]/[0-9]+\.png')) AS url, unnest(range(len(regexp_extract_all(words, 'https://[hg]/[0-9]+\.png')))) AS nth FROM ln),
    first AS (SELECT doc_id, url, min(line * 1000 + nth) AS place FROM each GROUP BY doc_id, url)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS i, url, (place // 1000)::INT AS line FROM first""",
)
def _embed_lines(spark, sf_dir):
    return sections.embed_lines(_notes(spark, sf_dir), "doc_id")


CLAIMED = "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS worker FROM documents WHERE doc_id < 40"


@query(
    "queue_claim",
    f"""WITH c AS (SELECT * FROM ({CLAIMED}) WHERE worker <> 'a'), free AS (SELECT id FROM ({OLD}) WHERE status = 'ocr' AND id NOT IN (SELECT id FROM c) ORDER BY id LIMIT 25)
    SELECT id, worker FROM c UNION ALL SELECT id, 'new' FROM free""",
)
def _claim(spark, sf_dir):
    """A worker is lost, and another one claims what waits."""
    old = _old(spark, sf_dir)
    return changes.claim(old, changes.release(spark.sql(CLAIMED), "a"), "ocr", "new", 25)


@query(
    "layout_upgrade",
    f"""WITH f AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'pdf' ELSE kind END AS kind, status FROM ({OLD}))
    SELECT id, kind, CASE WHEN kind = 'pdf' THEN 'pending' WHEN kind = 'text' AND id % 7 = 2 THEN 'ocr' ELSE status END AS status FROM f""",
)
def _upgrade(spark, sf_dir):
    files = _old(spark, sf_dir).withColumn("kind", F.when(F.col("id") % 4 == 0, "pdf").otherwise(F.col("kind")))
    chunks = spark.sql("SELECT doc_id AS file_id, CASE WHEN doc_id % 7 = 2 THEN 'ocr' ELSE 'text' END AS source FROM documents")
    return migrate.upgraded(3, {"pdf": "1"}, files, chunks)[1].select("id", "kind", "status")


@query("living_results", f"SELECT o.path FROM ({OLD}) o WHERE EXISTS (SELECT 1 FROM ({NEW}) n WHERE n.path = o.path)")
def _living(spark, sf_dir):
    old = _old(spark, sf_dir)
    return changes.living(old.select("path"), spark.sql(NEW))


# ---- languages and small functions -----------------------------------------------------------------------------

LANGS = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'en-US' WHEN 2 THEN ' fr-FR , de' WHEN 3 THEN 'xx-YY' WHEN 4 THEN 'zh-Hant' ELSE 'en, en-GB,hi-IN' END"


@query("normalised_languages", f"SELECT doc_id, coalesce(nullif(replace({LANGS}, ' ', ''), ''), 'en-US') AS langs FROM documents")
def _languages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.languages(F.expr(LANGS)).alias("langs"))


@query("recognition_languages", "SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN 'fra+deu' WHEN 4 THEN 'chi_tra' WHEN 5 THEN 'eng+hin' ELSE 'eng' END AS codes FROM documents")
def _recognition(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.recognition_languages(F.expr(LANGS)).alias("codes"))


@query("homoglyph_fold", f"SELECT doc_id, translate('ВТ Нос ' || lang, '{T.HOMOGLYPHS[0]}', '{T.HOMOGLYPHS[1]}') AS text FROM documents")
def _homoglyphs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.latin(F.concat(F.lit("ВТ Нос "), "lang"), F.lit("en-US")).alias("text"))


@query("osa_distance", "SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b, damerau_levenshtein(a, b)::INT AS distance FROM part")
def _osa(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("a"), F.element_at(F.split("p_name", " "), -1).alias("b"))
    return parts.withColumn("distance", T.osa("a", "b"))


@query("recency_factor", f"SELECT doc_id, round(1 + 0.2 * 30 / (30 + greatest(0, {NOW_MS} - (1700000000000 - doc_id * {DAY})) / 86400000.0), 12) AS factor FROM documents")
def _recency(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(search.recency(F.lit(1.0), F.lit(NOW_MS) - F.col("doc_id") * DAY, NOW_MS), 12).alias("factor"))


@query("prompt_excerpt", "SELECT doc_id, trim(text[1:1000], ' ' || chr(9) || chr(10) || chr(13)) AS excerpt FROM documents")
def _excerpt(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ask.excerpt(F.col("text")).alias("excerpt"))


@query("settings_parse", "SELECT doc_id, source || ',' || lang AS ignore FROM documents")
def _settings(spark, sf_dir):
    setting = F.to_json(F.struct(F.concat(F.lit("/"), "source", F.lit("/\n\n "), "lang", F.lit("\n")).alias("ignore"), F.lit("en").alias("ocrLang")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(extract.ignore_list(setting), ",").alias("ignore"))


@query("recognised_lines", "SELECT (p_partkey // 4)::BIGINT AS image, string_agg(p_brand, ' ' ORDER BY p_partkey) AS text FROM part GROUP BY 1")
def _boxes(spark, sf_dir):
    boxes = read(spark, sf_dir, "part").select((F.col("p_partkey") / 4).cast("long").alias("image"), F.col("p_brand").alias("text"), F.col("p_partkey").alias("x"), (F.col("p_partkey") % 2 * 0.1).alias("mid"), F.lit(1.0).alias("height"))
    return sections.box_lines(boxes)
