"""The driver's tables as a corpus of files and chunks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..plans.search import Index, pack

NOW_MS = 1_700_000_000_000
HOUR, DAY = 3_600_000, 86_400_000
TAGS = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, chunks): documents and benchmark items as notes, pages as HTML, conversations as files of a page for each turn."""
    docs = read(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 4).alias("id"), F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), text("doc_id"), F.lit(".md")).alias("path"), F.lit("text").alias("kind"),
        (F.lit(NOW_MS) - F.col("doc_id") * HOUR).alias("mtime"), F.col("n_chars").alias("size"), F.lit(0).alias("page"), F.concat(F.lit("doc_"), text("doc_id")).alias("name"), F.col("lang").alias("title"), F.col("text").alias("body"),
    )
    bench = read(spark, sf_dir, "benchmark").select(
        (F.col("item_id") * 4 + 1).alias("id"), F.concat(F.lit("bench/item_"), text("item_id"), F.lit(".txt")).alias("path"), F.lit("text").alias("kind"),
        (F.lit(NOW_MS) - F.col("item_id") * DAY).alias("mtime"), F.length("text").cast("long").alias("size"), F.lit(0).alias("page"), F.concat(F.lit("item_"), text("item_id")).alias("name"), F.lit("benchmark").alias("title"), F.col("text").alias("body"),
    )
    chat = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 4 + 2).alias("id"), F.concat(F.lit("chat/conv_"), text("conv_id"), F.lit(".pdf")).alias("path"), F.lit("pdf").alias("kind"),
        (F.lit(NOW_MS) - F.col("conv_id") * HOUR).alias("mtime"), F.lit(0).cast("long").alias("size"), (F.col("turn") + 1).cast("int").alias("page"), F.lit("").alias("name"), F.col("role").alias("title"), F.col("text").alias("body"),
    )
    web = read(spark, sf_dir, "pages").select(
        (F.col("page_id") * 4 + 3).alias("id"), F.concat(F.lit("web/page_"), text("page_id"), F.lit(".html")).alias("path"), F.lit("html").alias("kind"),
        (F.lit(NOW_MS) - F.col("page_id") * HOUR).alias("mtime"), F.length("html").cast("long").alias("size"), F.lit(0).alias("page"), F.concat(F.lit("page_"), text("page_id")).alias("name"), F.lit("").alias("title"), F.regexp_replace("html", TAGS, " ").alias("body"),
    )
    rows = docs.unionByName(bench).unionByName(chat).unionByName(web)
    files = rows.groupBy("id", "path", "kind").agg(F.min("mtime").alias("mtime"), F.max("size").alias("size")).select("id", "path", "kind", "mtime", "size", F.lit("done").alias("status"), F.lit("").alias("error"))
    chunks = rows.select(pack("id", "page").alias("rowid"), F.col("id").alias("file_id"), "page", "name", "title", "body", F.lit("text").alias("source"))
    return files, chunks


_built: dict[tuple[str, str], Index] = {}


def indexed(spark: SparkSession, sf_dir: str, keep: bool = True) -> Index:
    """The index of the driver's tables; built once in a session and kept in its executors' storage (memory, then disk)."""
    key = spark.sparkContext.applicationId, sf_dir
    if keep and key not in _built:
        _built[key] = indexed(spark, sf_dir, keep=False)
        for df in (_built[key].postings, _built[key].vocab, _built[key].stats):
            df.persist(StorageLevel.MEMORY_AND_DISK)
    if keep:
        return _built[key]
    files, chunks = corpus(spark, sf_dir)
    posts = index.postings(chunks)
    return Index(files, chunks, posts, index.corpus_stats(index.doc_stats(chunks)), index.vocabulary(posts))


#: The same as SQL: rows, files, chunks, tokens.
SQL = r"""
rows AS (
  SELECT doc_id * 4 AS id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, 'text' AS kind, 1700000000000 - doc_id * 3600000 AS mtime, n_chars AS size, 0 AS page, 'doc_' || doc_id AS name, lang AS title, text AS body FROM documents
  UNION ALL SELECT item_id * 4 + 1, 'bench/item_' || item_id || '.txt', 'text', 1700000000000 - item_id * 86400000, length(text), 0, 'item_' || item_id, 'benchmark', text FROM benchmark
  UNION ALL SELECT conv_id * 4 + 2, 'chat/conv_' || conv_id || '.pdf', 'pdf', 1700000000000 - conv_id * 3600000, 0, turn + 1, '', role, text FROM conversations
  UNION ALL SELECT page_id * 4 + 3, 'web/page_' || page_id || '.html', 'html', 1700000000000 - page_id * 3600000, length(html), 0, 'page_' || page_id, '', regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g') FROM pages),
files AS (SELECT id, path, kind, min(mtime) AS mtime, max(size) AS size FROM rows GROUP BY id, path, kind),
chunks AS (SELECT id * 1048576 + page AS rowid, id AS file_id, page, name, title, body FROM rows),
words AS (
  SELECT rowid, 0 AS col, regexp_extract_all(strip_accents(lower(name)), '[\p{L}\p{N}]+') AS w FROM chunks
  UNION ALL SELECT rowid, 1, regexp_extract_all(strip_accents(lower(title)), '[\p{L}\p{N}]+') FROM chunks
  UNION ALL SELECT rowid, 2, regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+') FROM chunks),
lens AS (SELECT rowid, sum(len(w)) AS len FROM words GROUP BY rowid),
stats AS (SELECT count(*) AS n_rows, sum(len) AS total_tokens FROM lens),
tok AS (SELECT rowid, col, unnest(w) AS term, unnest(range(len(w))) AS at FROM words)
"""
