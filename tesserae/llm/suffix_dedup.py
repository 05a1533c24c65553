"""Removal of repeated byte strings with suffix arrays.

Every byte of a string of LENGTH bytes that starts anywhere else too (in any text, the same one
included) is removed; matches never cross texts. Shorter repeats can be reported beside it.
1. Each window of LENGTH bytes has a least hash among its K-byte strings; successive windows with
   the same one form a stretch. Equal windows have equal least hashes, so they meet in one bucket.
2. Copies of a text count once, since all their windows repeat. Of equal stretches two places go on,
   and what is found for them holds for all places. A bucket of one stretch at one place, in which
   the least hash stands once, has no repeat.
3. The bytes of a bucket's stretches are cut into short phrases at places told by the window alone.
   The suffix array of the phrases, built by linear grouping (suffix_array.py), gives the intervals
   of places that share all phrases of a window; windows of one interval whose bytes before the
   first phrase and after the last one agree are equal, and those that have an equal are repeats.
Buckets of more than BLOCK bytes in different stretches are dealt to pairs of blocks, so that no
task holds more than two blocks of a bucket.

A window is a repeat only where its bytes were compared with another window's; copies of texts are
told by 64-bit hashes, and equal stretches by hashes of them and of their least K-byte string. Texts of PIECE bytes and
more are read in overlapping pieces, so that working memory does not follow the longest text.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; of rows that repeat
all bytes go (if they are long enough); bytes that are left are joined as they are, and where that
breaks a character, text() replaces its remains; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_view, mixed, powers, span_hashes, stored, text_blocks
from .jaccard_join import _groups
from .suffix_array import Intervals

#: A passage of just over 50 words takes about this many bytes; the shorter repeats that the query reports.
SHORT = 250
LENGTH, BLOCK, PIECE = 400, 1 << 19, 1 << 22
#: Windows of one stretch at most: longer ones, which lie in periodic text, are split.
MOST = 1024
#: Phrases are cut at the least of SPAN successive hashes of GRAM bytes.
SPAN, GRAM = 48, 8
#: Bytes of stretches that one suffix array holds about at most (more only for one bucket or pair of blocks).
HELD = 600_000
STRETCHES = "array<struct<mini: bigint, content: bigint, start: int, n: int, again: boolean>>"


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values."""
    m = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    table = full.reshape(-1, w)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-byte strings of data."""
    up, down = powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mixed((prefix[k:] - prefix[:-k]) * down[: len(data) - k + 1])


def stretches(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]):
    """Row, start (in data), number of windows, least hash, content hash, and whether the least hash occurs again, of each stretch.

    Windows have the least length; a content goes on to the end of a window of the greatest that starts in the stretch.
    """
    length = lengths[0]
    k = length // 5
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z > 0
    places = _rolling(data, k)
    least = sliding_least(places, length - k + 1)
    n = len(least)
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one row
    last = np.minimum(offsets[1:] - length + 1, n)
    has = last > offsets[:-1]
    np.add.at(inside, offsets[:-1][has], 1)
    np.add.at(inside, last[has], -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    heads = offsets[:-1][has]
    new[heads] = True
    starts = np.flatnonzero(new)
    count = np.bincount(np.cumsum(new)[ok] - 1, minlength=len(starts))
    if len(count) and count.max() > MOST:
        parts = -(-count // MOST)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST
        starts, count = np.repeat(starts, parts) + step, np.minimum(np.repeat(count, parts) - step, MOST)
    row = np.searchsorted(offsets, starts, "right") - 1
    content = span_hashes(data, starts, np.minimum(starts + count - 1 + lengths[-1], offsets[row + 1]))
    chosen = least_places(places, least, length - k + 1)
    first, end = np.searchsorted(chosen, starts), np.searchsorted(chosen, starts + count + length - k)
    of = np.repeat(np.arange(len(starts)), end - first)
    at = np.arange(len(of)) - np.repeat(np.cumsum(end - first) - (end - first), end - first) + first[of]
    again = np.bincount(of[places[chosen[at]] == least[starts[of]]], minlength=len(starts)) > 1
    return row, starts, count, least[starts], content, again


def least_places(places: np.ndarray, least: np.ndarray, w: int) -> np.ndarray:
    """The places that hold the least value of a window of w that they lie in; least: sliding_least(places, w)."""
    full = np.zeros(len(places) + w - 1, np.uint64)
    full[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(~sliding_least(~full, w)[: len(places)] == places)


def _found(lengths: tuple[int, ...], piece: int):
    kind = pa.struct([("mini", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])
    more = lengths[-1] - 1

    def pieces(batches):
        """Parts of a block, their bytes and offsets, the place of the first byte in its text, and the windows that count."""
        for part, data, offsets in text_blocks(batches, "text", 1 << 19):
            if part.num_rows > 1 or len(data) <= piece:
                yield part, data, offsets, 0, len(data)
                continue
            for at in range(0, max(len(data) - lengths[0] + 1, 1), piece):
                some = data[at : at + piece + more]
                yield part, some, np.array([0, len(some)]), at, piece

    def run(batches):
        for part, data, offsets, at, most in pieces(batches):
            row, start, n, mini, content, again = stretches(data, offsets, lengths)
            keep = start < most  # of a piece: a stretch may pass its end, and the next piece starts within
            row, start, n, mini, content, again = (x[keep] for x in (row, start, np.minimum(n, most - start), mini, content, again))
            value = pa.StructArray.from_arrays([pa.array(long_view(mini)), pa.array(long_view(content)), pa.array(start - offsets[row] + at, pa.int32()), pa.array(n, pa.int32()), pa.array(again)], fields=list(kind))
            heads = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
            get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("text_key"), pa.ListArray.from_arrays(pa.array(heads), value)], ["doc_id", "text_key", "found"])

    return run


def _cut_out(longest: int):
    names = ("mini", "size", "content", "start", "n", "body")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches):
        for part, data, offsets in text_blocks(batches, "text", 1 << 22):
            wanted = part.column(part.schema.get_field_index("wanted")).to_pylist()
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            out: list[list] = [[] for _ in names]
            for i, row in enumerate(wanted):
                if row[0]["doc_id"] != ids[i]:  # a copy of the text that is read already
                    continue
                for x in row:
                    first = offsets[i] + x["start"]
                    body = data[first : min(first + x["n"] - 1 + longest, offsets[i + 1])].tobytes()
                    for to, value in zip(out, (x["mini"], x["size"], x["content"], x["start"], x["n"], body), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], list(names))

    return run


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    full = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out |= full[i : i + len(data)].astype(np.uint64) << np.uint64(8 * i)
    return out


def repeats(bodies: list[bytes], counts: list[int], groups: list[int], length: int | tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """Runs of repeated windows: (body, number of the length, start in the body, number of windows).

    The windows that start at the first counts[i] places of body i count; two are compared if their
    bodies' groups are the same.
    """
    lengths = (length,) if isinstance(length, int) else length
    data = np.frombuffer(b"".join(bodies), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    # the place of the least hash of SPAN successive ones, of equal ones the first: it moves on with the places
    span = min(SPAN, lengths[0] // 4)
    gram = min(GRAM, lengths[0] - 2 * span)
    low = np.uint64((1 << 24) - 1)
    if len(data) > low:
        raise ValueError("too many bytes for one suffix array")
    where = (sliding_least((_rolling(data, gram) & ~low) | np.arange(len(data) - gram + 1, dtype=np.uint64), span) & low).astype(np.int64)
    per = np.maximum(np.diff(bounds) - span - gram + 2, 0)  # places of each body whose hashes all lie in it
    of = np.repeat(np.arange(len(bodies)), per)
    at = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per) + bounds[of]
    cut = where[at]
    new = np.ones(len(cut), bool)
    new[1:] = (cut[1:] != cut[:-1]) | (of[1:] != of[:-1])
    number = np.zeros(len(data), np.int64)  # of the first cut at or after each place
    number[at] = np.cumsum(new) - 1
    cuts, owner = cut[new], of[new]
    # a symbol for each phrase, by its bytes; the last cut of a body has a symbol of its own, so that no match crosses bodies
    end = np.append(owner[1:] != owner[:-1], True)
    ids: dict[bytes, int] = {}
    joined = data.tobytes()
    serial = len(cuts)
    text = [serial + i if e else ids.setdefault(joined[a:b], len(ids)) for i, (a, b, e) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), 0], end.tolist(), strict=True))]
    shared = Intervals(text)
    eight = _words(data)
    group = np.asarray(groups, np.int64)
    out = []
    for which, size in enumerate(lengths):
        n = np.minimum(np.asarray(counts, np.int64), np.maximum(np.diff(bounds) - size + 1, 0))
        of = np.repeat(np.arange(len(bodies)), n)
        if not len(of):
            continue
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + bounds[of]
        first, last = number[at], number[at + size - span - gram + 1]
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
        interval, others = shared.of(first[new], last[new] - first[new])
        back = np.cumsum(new) - 1
        keep = np.flatnonzero(others[back])
        if not len(keep):
            continue
        of, at, back = of[keep], at[keep], back[keep]
        where_cut, symbols = cuts[first[keep]] - at, (last - first)[keep]
        del first, last, new

        def parts(at, i=slice(None)):
            """All that two windows must have in common, for the windows in order i."""
            yield from (group[of[i]], interval[back[i]], symbols[i], where_cut[i])  # noqa: B023
            yield from (eight[at + k] for k in range(0, span, 8))
            yield from (eight[at + size - 8 - k] for k in range(0, span + gram, 8))  # noqa: B023

        key = np.zeros(len(at), np.uint64)
        for p in parts(at):
            key = mixed(key * np.uint64(3) + p.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        del key
        same = np.ones(len(order) - 1, bool)
        for p in parts(at[order], order):
            same &= p[1:] == p[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        of, at = of[twice], at[twice]
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], len(at))
        out += zip(of[heads].tolist(), [which] * len(heads), (at[heads] - bounds[of[heads]]).tolist(), (ends - heads).tolist(), strict=True)
    return out


def _repeated(lengths: tuple[int, ...]):
    """Rows (mini, low, high, content, n, body) to the repeated windows (mini, content, n, which length, start, number) of the contents."""
    names = ["mini", "content", "n", "which", "first", "windows"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def settled(rows: list[tuple]) -> pa.RecordBatch:
        found = repeats([r[4] for r in rows], [r[3] for r in rows], [r[0] for r in rows], lengths)
        out = list({(*rows[i][1:4], *x) for i, *x in found})
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    def run(batches):
        held: list[tuple] = []
        size = serial = 0
        for t, heads in _groups(batches, ["mini", "low", "high"]):
            cols = [t[c].to_pylist() for c in ("mini", "content", "n", "body")]
            for s, e in zip(heads.tolist(), heads[1:].tolist(), strict=False):
                more = [(serial, *r) for r in zip(*(c[s:e] for c in cols), strict=True)]
                length = sum(len(r[4]) for r in more)
                if held and size + length > HELD:
                    yield settled(held)
                    held, size = [], 0
                held += more
                size += length
                serial += 1
        if held:
            yield settled(held)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source") if c in docs.columns], F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def spans(rows: DataFrame, lengths: tuple[int, ...], block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(text_key, copies, spans array<struct<which, start, n>>): of texts that may have repeats, the rows with the text and the windows of each length that start elsewhere too, as runs of start places.

    rows: keyed(docs). Its columns all go through the join that fetches texts, so that the shuffle is
    the same as that of deduplicated() and is run once.
    """
    found = rows.select("doc_id", "text_key", "text").mapInArrow(_found(lengths, piece), f"doc_id long, text_key long, found {STRETCHES}").select("doc_id", "text_key", F.inline("found"))
    texts = stored(found.groupBy("mini", "content", "n", "text_key", "start").agg(F.count("*").alias("count"), F.min("doc_id").alias("doc_id"), F.bool_or("again").alias("again")), "stretches")
    met = texts.groupBy("mini").agg(F.sum("count").alias("places"), F.bool_or("again").alias("again")).where("places > 1 or again")
    near = stored(texts.join(met.select("mini"), "mini", "left_semi"), "met")
    place = F.struct("text_key", "start", "doc_id")
    each = near.groupBy("mini", "content", "n").agg(F.min(place).alias("place"), F.max(place).alias("other"), F.bool_or("again").alias("again"))
    kinds = near.groupBy("mini", "content", "n").agg(F.lit(1)).groupBy("mini").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + lengths[-1]).alias("size"))
    wanted = each.join(kinds, "mini").where("kinds > 1 or place != other or again").withColumn("at", F.explode(F.array_distinct(F.array("place", "other"))))
    places = wanted.groupBy(F.col("at.text_key").alias("text_key")).agg(F.collect_list(F.struct("mini", "size", "content", "at.start", "n", "at.doc_id")).alias("wanted"))
    bodies = rows.join(places, "text_key").mapInArrow(_cut_out(lengths[-1]), "mini long, size long, content long, start int, n int, body binary")
    n = F.ceil(F.col("size") / block).cast("int")
    dealt = bodies.withColumn("side", F.pmod(F.xxhash64("content"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).select("mini", "low", "high", "content", "n", "body")
    checked = dealt.repartition("mini", "low", "high").sortWithinPartitions("mini", "low", "high").mapInArrow(_repeated(lengths), "mini long, content long, n int, which int, first int, windows int")
    all_places = near.select("mini", "content", "n", "text_key", "start", "count").join(checked, ["mini", "content", "n"], "left")
    run = F.struct("which", (F.col("start") + F.col("first")).alias("start"), F.col("windows").alias("n"))
    return all_places.groupBy("text_key").agg(F.max("count").alias("copies"), F.collect_list(F.when(F.col("windows").isNotNull(), run)).alias("spans"))


def _runs(spans: list[dict] | None, length: int, which: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows."""
    out: list[list[int]] = []
    for s, n in sorted((x["start"], x["n"]) for x in spans or () if x["which"] == which):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + length)
        else:
            out.append([s, s + n - 1 + length])
    return [(s, e) for s, e in out]


def _removed(lengths: tuple[int, ...], length: int):
    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "removed", "kept")}
            text = b.column(b.schema.get_field_index("text")).cast(pa.large_string()).fill_null("")
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            for value, copies, spans in zip(text, get("copies"), get("spans"), strict=True):
                data = value.as_buffer().to_pybytes()
                runs, shorter = ([(0, len(data))] if copies and copies > 1 and len(data) >= n else _runs(spans, n, lengths.index(n)) for n in (length, lengths[0]))
                edges = [0, *(x for r in runs for x in r), len(data)]
                left = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if runs else data
                for c, v in zip(out, (len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), sum(e - s for s, e in shorter), [{"start": s, "end": e} for s, e in runs], left), strict=True):
                    out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
            rest = [c for c in b.schema.names if c not in ("text", "copies", "spans")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], [*rest, *out])

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, short: int | None = None, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, lang and source if docs has them, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, removed (byte runs), kept (the bytes left).

    n_repeated: bytes under strings of short bytes that start elsewhere too (short None: of length bytes). They are counted, not removed.
    """
    lengths = (length,) if short in (None, length) else tuple(sorted((short, length)))
    rows = keyed(docs)
    met = rows.join(spans(rows, lengths, block, piece), "text_key", "left").drop("text_key")
    rest = "".join(f"{c} string, " for c in ("lang", "source") if c in docs.columns)
    return met.mapInArrow(_removed(lengths, length), f"doc_id long, {rest}n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, removed array<struct<start: int, end: int>>, kept binary")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) without repeated strings; those of which nothing but white space is left go."""
    out = deduplicated(docs, length)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    out = out.select("doc_id", text.alias("text"), "lang", "source", "n_removed").withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text", "lang", "source", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at LENGTH, and n_repeated: bytes in repeats of SHORT bytes or more, which include passages too short to be removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs, short=SHORT).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
