"""Best-fit packing of documents into training sequences of several permitted lengths.

Bins depend on lengths alone, so the number of pieces of each length (at most the largest
capacity many numbers) is all that the driver sees. Best-fit decreasing runs over these counts:
bins with the same contents are one group with a range of bin numbers, so that a step places all
pieces of one length at once, just as placing them one by one would. Where no open bin fits, a bin
of the least cost is opened; each rule for that choice is tried on the counts, the cheapest plan
wins, and at last each bin shrinks to the smallest permitted length that holds its contents.
The plan (ranges of ranks within a length, with their bins) is bounded by the capacities; each
piece finds its bin by its length and its rank among the pieces of that length.

A document has a token for each word [^\\x20\\x09-\\x0D]+ and one for its end; it is cut into
pieces of the largest capacity and a rest.

Defined results: a null or empty text is one piece of one token; rows that repeat are packed each;
an empty table gives an empty result; other columns are not read. Bin numbers have no gaps.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_blocks, words_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs beside its padded length, in tokens; pieces of a length are ranked in parts of about PART.
OVERHEAD, PART = 16, 1 << 18
PIECES = "doc_id long, piece int, start_token long, n_tokens int"


class Plan:
    """ranges: length, first rank, end rank, first bin, pieces in a bin, tokens before them; bins: first bin, end, tokens used."""

    def __init__(self, capacities: tuple[int, ...], overhead: int = OVERHEAD):
        self.capacities, self.overhead = capacities, overhead
        self.ranges: list[tuple[int, int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int, int]]] = {}
        self.rests: list[int] = []
        self.n_bins = 0

    def _put(self, first: int, end: int, used: int, rest: int) -> None:
        if first < end:
            if rest not in self.open:
                insort(self.rests, rest)
                self.open[rest] = []
            self.open[rest].append((first, end, used))

    def place(self, length: int, count: int, opened: Callable[[int, int], int]) -> None:
        rank = 0
        while rank < count:
            k = bisect_left(self.rests, length)
            if k < len(self.rests):
                rest = self.rests[k]
                first, end, used = self.open[rest].pop()
                if not self.open[rest]:
                    del self.open[rest], self.rests[k]
            else:
                rest = opened(length, count - rank)
                first, end, used = self.n_bins, self.n_bins + -(-(count - rank) // (rest // length)), 0
                self.n_bins = end
            each = rest // length
            full = min(end - first, (count - rank) // each)
            if full:
                self.ranges.append((length, rank, rank + full * each, first, each, used))
                self._put(first, first + full, used + each * length, rest - each * length)
                rank, first = rank + full * each, first + full
            if first < end and rank < count:
                last = count - rank
                self.ranges.append((length, rank, count, first, last, used))
                self._put(first, first + 1, used + last * length, rest - last * length)
                rank, first = count, first + 1
            self._put(first, end, used, rest)

    def bins(self) -> list[tuple[int, int, int, int]]:
        """First bin, end, tokens used, permitted length."""
        found = sorted(x for group in self.open.values() for x in group)
        return [(a, b, used, next(c for c in self.capacities if c >= used)) for a, b, used in found]

    def cost(self) -> int:
        return sum((b - a) * (c + self.overhead) for a, b, _, c in self.bins())


def planned(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """The cheapest of the plans by each rule of opening bins: one preferred length each, and the least cost of a token."""
    capacities = tuple(sorted(capacities))
    lengths = sorted(counts, reverse=True)
    after = dict(zip(lengths, np.cumsum([0] + [n * counts[n] for n in reversed(lengths)])[:-1][::-1].tolist(), strict=True))

    def prefer(size: int) -> Callable[[int, int], int]:
        return lambda length, _: next(c for c in capacities if c >= max(length, min(size, capacities[-1])))

    def least(length: int, count: int) -> int:
        def per_token(c: int) -> float:
            each = min(count, c // length)
            bins = -(-count // (c // length))
            filled = each * length + min(c - each * length, after[length] / bins)
            return (next(x for x in capacities if x >= filled) + overhead) / filled

        return min((c for c in capacities if c >= length), key=lambda c: (per_token(c), -c))

    best = None
    for rule in (least, *(prefer(c) for c in capacities)):
        plan = Plan(capacities, overhead)
        for n in lengths:
            plan.place(n, counts[n], rule)
        if best is None or plan.cost() < best.cost():
            best = plan
    return best


def _pieces(capacity: int):
    def run(batches):
        for part, data, offsets in text_blocks(batches, "text"):
            n = len(offsets) - 1
            tokens = np.bincount(words_of(data, offsets)[2], minlength=n) + 1
            each = -(-tokens // capacity)
            row = np.repeat(np.arange(n), each)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            size = np.minimum(tokens[row] - start, capacity)
            ids = part.column(part.schema.get_field_index("doc_id")).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32())], [c.split()[0] for c in PIECES.split(", ")])

    return run


def _dealt(ranges: np.ndarray, bins: np.ndarray):
    def run(batches):
        keys = (ranges[:, 0] << 44) | ranges[:, 1]
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            size, rank = get("n_tokens").astype(np.int64), get("rank").astype(np.int64)
            _, first_rank, _, first_bin, each, used = ranges[np.searchsorted(keys, (size << 44) | rank, "right") - 1].T
            number = first_bin + (rank - first_rank) // each
            offset = used + (rank - first_rank) % each * size
            cap = bins[np.searchsorted(bins[:, 0], number, "right") - 1, 3]
            out = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start_token", "n_tokens")]
            names = ["doc_id", "piece", "start_token", "n_tokens", "bin_id", "bin_capacity", "bin_offset"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(number, pa.int64()), pa.array(cap, pa.int32()), pa.array(offset, pa.int32())], names)

    return run


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, part: int = PART, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, bin_id, bin_capacity, bin_offset): every token of every document in one bin.

    Pieces of one length are told apart by their place in the stored table alone, so that rows that repeat are dealt like others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(max(capacities)), PIECES), "pieces")
    parts = [(r.n_tokens, -(-r["count"] // part)) for r in pieces.groupBy("n_tokens").count().collect()]  # at most capacity rows
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    parted = pieces.select("*", place.alias("place")).join(F.broadcast(spark.createDataFrame(parts, "n_tokens int, parts long")), "n_tokens")
    pieces = parted.withColumn("salt", F.pmod("place", "parts").cast("int")).drop("place", "parts")
    by_salt = pieces.groupBy("n_tokens", "salt").count().collect()  # at most a row for each length and each part pieces
    counts: dict[int, int] = {}
    before = []
    for r in sorted(by_salt):
        before.append((r.n_tokens, r.salt, counts.get(r.n_tokens, 0)))
        counts[r.n_tokens] = counts.get(r.n_tokens, 0) + r["count"]
    plan = planned(counts, capacities, overhead)
    ranges = np.array(sorted(plan.ranges), np.int64).reshape(-1, 6)
    bins = np.array(plan.bins(), np.int64).reshape(-1, 4)
    offsets = spark.createDataFrame(before, "n_tokens int, salt int, before long")
    own = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(F.broadcast(offsets), ["n_tokens", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    return ranked.select("doc_id", "piece", "start_token", "n_tokens", "rank").mapInArrow(_dealt(ranges, bins), "doc_id long, piece int, start_token long, n_tokens int, bin_id long, bin_capacity int, bin_offset int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
