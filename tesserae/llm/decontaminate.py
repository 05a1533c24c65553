"""Benchmark decontamination by templates.

Words are folded (lower case, outer punctuation off) and numbers, units after numbers, and names
(capitalised words) become typed placeholders, a run of placeholders of one type one slot. Windows
of WINDOW template words, of items and documents alike, are hashed and joined; each match carries the words that stood in the slots. The
matches of a document and an item at one distance are consistent if equal words of the item's
slots nearly always meet equal words of the document's; so a re-parameterised question (other
numbers and names, each put in throughout) is caught while chance likeness is not. A document is
contaminated if consistent matches cover MIN_SHARE of an item's words, or if RUN successive words of
it stand there as they are. Windows are hashed in three kinds: with and without placeholders for
names, so that text in other case is caught as well, and of the folded words themselves, so that
items rich in numbers are.

Items of fewer template words than WINDOW are matched as one window of their length. A window with
placeholders needs LITERALS words that are none (half of the item's words, if it is short).

Defined results: a null or empty text is clean, a null or empty item matches nothing; items that
repeat count each, by their id; a null item id sorts last; rows that repeat get equal results each;
an empty table of either kind gives clean documents; other columns are not read.

The benchmark's hashes go to all workers only while they are at most BOUND (16 MB); beyond that
every window of the documents goes to the join, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD, long_view, mixed, powers, span_hashes, stored, text_blocks, words_of

WINDOW, LITERALS, MIN_SHARE, CONSISTENT, RUN, BOUND, FEW = 8, 4, 0.5, 0.7, 13, 1 << 21, 1 << 17
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split()
UNITS = "mm cm m km in inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons ml l litre litres liter liters gallon gallons second seconds s sec minute minutes min hour hours h day days week weeks month months year years percent degrees degree dollar dollars cent cents euro euros usd eur mph kmh watt watts volt volts joule joules newton newtons hz khz mhz".split()
_byte = np.arange(256)
INNER = (_byte >= 128) | np.isin(_byte, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
DIGIT, UPPER = (_byte >= 48) & (_byte < 58), (_byte >= 65) & (_byte < 91)
NUM, UNIT, NAME = np.uint64(0x11), np.uint64(0x22), np.uint64(0x33)
HIT = "struct<h: bigint, at: int, slots: array<bigint>>"


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = words_of(data, np.array([0, len(data)]))
    return span_hashes(data, s, e)


NUMBER_HASHES, UNIT_HASHES = np.sort(_hash_of(NUMBER_WORDS)), np.sort(_hash_of(UNITS))


def templates(data: np.ndarray, offsets: np.ndarray):
    """Rows, the two template hashes, slot flags of each, and value hashes of the words."""
    starts, ends, rows = words_of(data, offsets)
    low = LOWER[data]
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) else np.zeros(0, int)
    upper = UPPER[data]
    low[accent] += 32
    upper[accent - 1] = True
    while len(at := np.flatnonzero((starts < ends) & ~INNER[data[np.minimum(starts, len(data) - 1)]])):
        starts[at] += 1
    while len(at := np.flatnonzero((starts < ends) & ~INNER[data[ends - 1]])):
        ends[at] -= 1
    keep = starts < ends
    starts, ends, rows = starts[keep], ends[keep], rows[keep]
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return rows, z, z, z > 0, z > 0, z
    value = span_hashes(low, starts, ends)
    number = DIGIT[data[starts]] | np.isin(value, NUMBER_HASHES)
    unit = np.isin(value, UNIT_HASHES) & np.concatenate([[False], number[:-1] & (rows[1:] == rows[:-1])]) & ~number
    name = upper[starts] & ~number & ~unit
    plain = np.where(number, NUM, np.where(unit, UNIT, value))
    return rows, np.where(name, NAME, plain), plain, number | unit | name, number | unit, value


def sequences(data: np.ndarray, offsets: np.ndarray):
    """Of each kind its template words: kind, rows, codes, slot flags, value hashes, first words; and the words' rows."""
    rows, named, plain, named_slots, plain_slots, value = templates(data, offsets)
    for kind, codes, slots in ((0, named, named_slots), (1, plain, plain_slots)):
        head = np.ones(len(rows), bool)
        head[1:] = ~(slots[1:] & slots[:-1] & (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1]))
        at = np.flatnonzero(head)
        place = np.arange(len(rows)) - np.repeat(at, np.diff(np.append(at, len(rows))))
        values = mixed(np.add.reduceat(value * powers(len(rows))[0][place], at)) if len(at) else value
        yield kind, rows[at], codes[at], slots[at], values, at, rows
    yield 2, rows, value, np.zeros(len(rows), bool), value, np.arange(len(rows)), rows


def _windows(rows, codes, slots, n: int, kind: int):
    """Hash and first word of each window, and its number of words that are no placeholders."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.concatenate([[0], np.cumsum(slots)])
    literals = n - (count[n:] - count[:-n])
    at = np.flatnonzero((rows[:m] == rows[n - 1 :]) & (literals >= min(LITERALS, -(-n // 2))))
    out = np.full(len(at), n * 3 + kind, np.uint64)
    for k in range(n):
        out = out * WORD + codes[at + k]
    return mixed(out), at, literals[at]


def _found(data, offsets, sizes, table):
    """Row, window hash, first template word (within the row) and slot values of the windows of sizes (kind, length) in the table (or all)."""
    for kind, rows, codes, slots, values, _, _ in sequences(data, offsets):
        first = np.searchsorted(rows, np.arange(len(offsets)))
        for n in (n for k, n in sizes if k == kind):
            h, at, _ = _windows(rows, codes, slots, n, kind)
            if table is not None:
                k = np.searchsorted(table, h)
                hit = table[np.minimum(k, len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)
                h, at = h[hit], at[hit]
            for x, a in zip(long_view(h).tolist(), at.tolist(), strict=True):
                own = np.flatnonzero(slots[a : a + n]) + a
                yield int(rows[a]), x, int(a - first[rows[a]]), long_view(values[own]).tolist()


def _hits(sizes, table):
    def run(batches):
        for part, data, offsets in text_blocks(batches, "text"):
            hits: list[list] = [[] for _ in range(len(offsets) - 1)]
            for row, h, at, slots in _found(data, offsets, sizes, table):
                hits[row].append({"h": h, "at": at, "slots": slots})
            kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("text_key")), pa.array(hits, kind)], ["doc_id", "text_key", "hits"])

    return run


def _items(batches):
    for part, data, offsets in text_blocks(batches, "text"):
        ids = part.column(part.schema.get_field_index("item_id")).to_pylist()
        out = []
        for kind, rows, codes, slots, values, words, of_words in sequences(data, offsets):
            size, n_words = np.bincount(rows, minlength=len(ids)), np.bincount(of_words, minlength=len(ids))
            first, first_word = (np.searchsorted(x, np.arange(len(offsets))) for x in (rows, of_words))
            least = np.minimum(LITERALS, -(-np.minimum(WINDOW, n_words) // 2))
            ends = np.append(words, len(of_words))
            for n in {min(WINDOW, int(x)) for x in size if x}:
                for h, a, literals in zip(*_windows(rows, codes, slots, n, kind), strict=True):
                    r = int(rows[a])
                    if min(WINDOW, size[r]) == n and (kind == 2 or literals >= least[r]):
                        own = np.flatnonzero(slots[a : a + n]) + a
                        out.append((ids[r], int(n_words[r]), kind, n, int(h.view(np.int64)), int(a - first[r]), int(words[a] - first_word[r]), int(ends[a + n] - first_word[r]), long_view(values[own]).tolist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 9
        kinds = (pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 3, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "n_words", "kind", "n", "h", "item_at", "item_from", "item_to", "item_slots"])


def matches(docs: DataFrame, items: DataFrame, bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text_key), and (text_key, item_id, covered, share) of each contaminated text and item."""
    windows = stored(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items, "item_id long, n_words int, kind int, n int, h long, item_at int, item_from int, item_to int, item_slots array<long>"), "windows")
    sizes = sorted((r.kind, r.n) for r in windows.select("kind", "n").distinct().collect())  # at most 3 * WINDOW
    table, n_windows = None, windows.count()
    if n_windows <= bound:
        table = np.unique(windows.select("h").distinct().toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(_hits(sizes, table), f"doc_id long, text_key long, hits array<{HIT}>"), "hits")
    hits = rows.where(F.size("hits") > 0).groupBy("text_key").agg(F.any_value("hits").alias("hits")).select("text_key", F.explode("hits").alias("x")).select("text_key", "x.h", "x.at", "x.slots")
    # windows that very many texts hold meet no single task where the benchmark's windows are few
    met = hits.join(F.broadcast(windows) if n_windows <= min(bound, FEW) else windows, "h").withColumn("shift", F.col("at") - F.col("item_at"))
    place = ["text_key", "item_id", "kind", "shift"]
    pairs = met.select(*place, F.explode(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("p")).groupBy(*place, "p.i", "p.d").count()
    agreed = pairs.groupBy(*place, "i").agg(F.max("count").alias("most"), F.sum("count").alias("all")).groupBy(*place).agg((F.sum("most") / F.sum("all")).alias("agreement"))
    spans = met.groupBy(*place, "n_words").agg(F.collect_set(F.struct("item_from", "item_to")).alias("at")).join(agreed, place, "left").where(F.coalesce("agreement", F.lit(1.0)) >= CONSISTENT)
    # windows of folded words that begin at successive words of the item make a verbatim run
    more = RUN - WINDOW
    begins = F.array_sort(F.col("at.item_from"))
    run = (F.col("kind") == 2) & (F.size("at") > more) & F.exists(F.sequence(F.lit(0), F.greatest(F.size("at") - more - 1, F.lit(0))), lambda i: F.get(begins, i + more) - F.get(begins, i) == more)
    covered = spans.select("text_key", "item_id", "n_words", F.coalesce(run, F.lit(False)).alias("run"), F.explode("at").alias("a")).select("text_key", "item_id", "n_words", "run", F.explode(F.sequence(F.col("a.item_from"), F.col("a.item_to") - 1)).alias("w"))
    covered = covered.groupBy("text_key", "item_id", "n_words", "w").agg(F.max("run").alias("run"))
    found = covered.groupBy("text_key", "item_id", "n_words").agg(F.count("w").alias("covered"), F.max("run").alias("run"))
    return rows.select("doc_id", "text_key"), found.withColumn("share", F.col("covered") / F.col("n_words")).where((F.col("share") >= MIN_SHARE) | F.col("run")).drop("n_words", "run")


def checked(docs: DataFrame, items: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, text_key, contaminated, n_items, item_ids, share): one row per document; item_ids ascending, share the largest."""
    rows, found = matches(docs, items, bound)
    by_text = found.groupBy("text_key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("share").alias("share"))
    out = rows.join(by_text, "text_key", "left")
    return out.select("doc_id", "text_key", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, items: DataFrame, bound: int = BOUND) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) that no item contaminates."""
    _, found = matches(docs, items, bound)
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return keyed.join(found.select("text_key").distinct(), "text_key", "left_anti").drop("text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")
