"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits made 0, white space collapsed) and hashed. For each
host the distinct documents that hold a line are counted; exact copies of a text are one document.
A line in more than ``limit`` documents of its host is removed from all of them but the one with
the lowest id (and that text's copies). A document is depleted, and rejected, if fewer than
``min_words`` words or less than ``min_share`` of its words remain.

Defined results: a null text is empty (no words, base_failed); a null host is a host of its own,
the same as the empty one; a null id sorts last; rows that repeat get the same verdict each; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_DIGITS, SPACE, WORD, lists, long_view, mixed, powers, span_hashes, stored, text_blocks, windows_of, words_of

LIMIT, MIN_WORDS, MIN_SHARE = 20, 10, 0.3
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _lines(data, offsets):
    """Starts, ends and rows of \\n-split lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    return starts, ends


def line_hashes(data, offsets):
    """For each line with a word: start, end, row, hash of the normalised line, number of words."""
    starts, ends, _ = words_of(data, offsets)
    h = span_hashes(LOWER_DIGITS[data], starts, ends)
    l0, l1 = _lines(data, offsets)
    w0, w1 = np.searchsorted(starts, l0), np.searchsorted(starts, l1)
    has = w1 > w0
    l0, l1, w0, w1 = l0[has], l1[has], w0[has], w1[has]
    if not len(w0):
        return l0, l1, l0, np.zeros(0, np.uint64), w0
    rank = np.arange(len(h)) - np.repeat(w0, w1 - w0)
    up, _ = powers(int(rank.max()) + 1)
    return l0, l1, np.searchsorted(offsets, l0, "right") - 1, mixed(np.add.reduceat(h * up[rank], w0)), w1 - w0


def _measure(batches):
    for part, data, offsets in text_blocks(batches, "text"):
        n = len(offsets) - 1
        starts, ends, rows = words_of(data, offsets)
        words = np.bincount(rows, minlength=n)
        chars = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
        hashes, at = windows_of(span_hashes(data, starts, ends), rows, 5)
        keys = mixed(hashes + rows[at].astype(np.uint64) * WORD)
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        cover = np.zeros(len(starts) + 6, np.int32)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 5, -1)
        repeat = np.bincount(rows[np.cumsum(cover)[: len(rows)] > 0], minlength=n)
        l0, l1, lrow, lhash, lwords = line_hashes(data, offsets)
        raw = mixed(span_hashes(data, l0, l1) + lrow.astype(np.uint64) * WORD)
        _, first = np.unique(raw, return_index=True)
        dups = np.bincount(lrow, minlength=n) - np.bincount(lrow[first], minlength=n)
        get = lambda c: part.column(part.schema.get_field_index(c))
        whole = [words, chars[offsets[1:]] - chars[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], dups, repeat]
        yield pa.RecordBatch.from_arrays(
            [get("doc_id"), get("host"), get("text_key"), *(pa.array(x, pa.int64()) for x in whole), lists(long_view(lhash), lrow, n, pa.int64()), lists(lwords, lrow, n, pa.int32())],
            ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
        )


def measured(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: the base measures, and hash and words of each of its lines."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(_measure, f"doc_id long, host string, text_key long, {MEASURES}, line_hash array<long>, line_words array<int>")


def removed_lines(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, text_key, lines array<long>, words long): the lines that each text loses. rows: what measured() returns, stored."""
    texts = rows.groupBy("host", "text_key").agg(F.min("doc_id").alias("lowest"), F.any_value("line_hash").alias("hashes"), F.any_value("line_words").alias("words"))
    held = texts.select("host", "text_key", F.struct(F.col("lowest").isNull().alias("none"), "lowest", "text_key").alias("who"), F.explode(F.array_distinct("hashes")).alias("line"))
    frequent = held.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("who").alias("who")).where(F.col("docs") > limit).select("host", "line", F.col("who.text_key").alias("keeper"))
    each = texts.select("host", "text_key", F.explode(F.arrays_zip("hashes", "words")).alias("x")).groupBy("host", "text_key", F.col("x.hashes").alias("line")).agg(F.sum("x.words").alias("words"))
    return each.join(frequent, ["host", "line"]).where(F.col("text_key") != F.col("keeper")).groupBy("host", "text_key").agg(F.collect_list("line").alias("lines"), F.sum("words").alias("words"))


def verdicts(docs: DataFrame, limit: int = LIMIT, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, **columns: str) -> DataFrame:
    """One row per document: the base measures, base_failed, kept, words_left, and the hashes of the lines to remove."""
    rows = stored(measured(docs, **columns), "lines")
    lost = removed_lines(rows, limit)
    left = F.col("n_words") - F.coalesce("words", F.lit(0))
    out = rows.drop("line_hash", "line_words").join(lost, ["host", "text_key"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < min_words) | (left < min_share * F.col("n_words"))
    return out.select("doc_id", "host", "text_key", *[c.split()[0] for c in MEASURES.split(", ")], failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.alias("words_left"), F.col("lines").alias("removed_lines"))


def _cut(batches):
    for batch in batches:
        gone = batch.column(batch.schema.get_field_index("removed_lines")).to_pylist()
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        for i, lines in enumerate(gone):
            if lines:
                data = np.frombuffer(texts[i].encode(), np.uint8)
                l0, l1, _, h, _ = line_hashes(data, np.array([0, len(data)]))
                stay = np.ones(len(data), bool)
                for k in np.flatnonzero(np.isin(long_view(h), np.array(lines, np.int64))):
                    stay[l0[k] : l1[k] + 1] = False
                texts[i] = data[stay].tobytes().decode()
        names = [c for c in batch.schema.names if c != "removed_lines"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names], names)


def cleaned(docs: DataFrame, **params) -> DataFrame:
    """The documents that are kept, with the frequent lines taken out of their texts; doc_id, text, lang, source, n_chars."""
    kept = verdicts(docs, **params).where("kept").select("host", "text_key", "removed_lines").dropDuplicates(["host", "text_key"])
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    out = keyed.join(kept, ["host", "text_key"]).select("doc_id", "text", "lang", "source", "n_chars", "removed_lines")
    return out.mapInArrow(_cut, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[c.split()[0] for c in MEASURES.split(", ")], "base_failed", "kept")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g
        FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
ln AS (SELECT r, host, doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
       array_to_string(regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS norm FROM ln),
word_lines AS (SELECT * FROM lw WHERE nw > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM word_lines GROUP BY r),
held AS (SELECT host, norm, text, min(doc_id) AS lowest FROM word_lines GROUP BY ALL),
lowest AS (SELECT host, text, min(doc_id) AS lowest FROM d GROUP BY ALL),
freq AS (SELECT host, norm, arg_min(text, coalesce(l, 9223372036854775807)) AS keeper
         FROM (SELECT h.host, h.norm, h.text, o.lowest AS l FROM held h JOIN lowest o USING (host, text)) GROUP BY host, norm HAVING count(*) > {LIMIT}),
lost AS (SELECT r, sum(nw) AS n FROM word_lines JOIN freq USING (host, norm) WHERE text <> keeper GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      len(words) - coalesce(lost.n, 0) AS n_left
      FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND n_left >= {MIN_WORDS} AND n_left >= {MIN_SHARE} * n_words AS kept
FROM f
"""
