"""The inverted index: chunks to postings, lengths, corpus statistics and vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

COLUMNS = ("name", "title", "body")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, rowid, col, pos, len): one row for each term of each column of a chunk; len is the chunk's number of tokens.

    All tokens of a chunk are in one input partition, so that the partial aggregation is already
    the final one and the shuffle carries a row for each result row.
    """
    cols = chunks.select("rowid", *[tokens(F.coalesce(c, F.lit(""))).alias(c) for c in COLUMNS])
    size = sum((F.size(c) for c in COLUMNS), F.lit(0))
    by_col = cols.select("rowid", size.alias("len"), F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("col"), F.col(c).alias("words")) for i, c in enumerate(COLUMNS)])).alias("x"))
    each = by_col.select("rowid", "len", "x.col", F.posexplode("x.words").alias("at", "term"))
    return each.groupBy("term", "rowid", "col", "len").agg(F.array_sort(F.collect_list("at")).alias("pos")).select("term", "rowid", "col", "pos", "len")


def doc_stats(chunks: DataFrame) -> DataFrame:
    return chunks.select("rowid", sum((F.size(tokens(F.coalesce(c, F.lit("")))) for c in COLUMNS), F.lit(0)).cast("long").alias("len"))


def file_sizes(chunks: DataFrame) -> DataFrame:
    """(file_id, n, len): chunks and tokens of each file; the corpus statistics are their sums."""
    sizes = sum((F.size(tokens(F.coalesce(c, F.lit("")))) for c in COLUMNS), F.lit(0)).cast("long")
    return chunks.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(sizes).alias("len"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_tokens"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, doc, cnt): chunks that hold the term, and its occurrences. A chunk's three columns are counted once by a bitmap."""
    per_row = posts.groupBy("term", "rowid").agg(F.sum(F.size("pos")).alias("n"))
    return per_row.groupBy("term").agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))


def write(posts: DataFrame, path: str, partitions: int | None = None) -> None:
    """Lay postings out by term: range partitions, sorted, so that prefix and range predicates prune files and row groups."""
    by = (partitions,) if partitions else ()
    posts.repartitionByRange(*by, "term", "rowid").sortWithinPartitions("term", "rowid", "col").write.mode("overwrite").parquet(path)
