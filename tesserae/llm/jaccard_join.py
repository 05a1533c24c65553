"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of word N-grams (5 words [^\\x20\\x09-\\x0D]+; a text of fewer words is one gram).
1. Equal sets are one class. Each class gets 128 MinHash values of 16 bits.
2. Classes that agree in 4 successive values (32 bands) meet in a bucket. Values of a pair are
   compared 16 at a time; it is dropped as soon as the posterior probability (uniform prior) that
   its similarity reaches the threshold falls below TOLERANCE. What survives links classes into
   groups, by union within a bucket and by contraction between buckets; no pair is emitted.
3. The grams of a group's classes meet in blocks; pairs pass the incremental comparison on all 128
   values and are then verified exactly. Each block returns counts of links and a spanning forest.
A bucket or group of more than BLOCK members is dealt to pairs of blocks, so that no task holds
more than two blocks and the row count grows with members times blocks, never with their square.

A pair of similarity 0.8 meets in no bucket with probability 5e-8 and is pruned with probability
of about 1e-6; all other decisions are exact.

Defined results: a text without a word is in no link and a class of its own; rows that repeat are
copies of each other; a null id sorts last, and class_id is null only if all ids of a class are; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, lists, long_view, met_by, mixed, span_hashes, stored, text_blocks, windows_of, words_of
from .components import components

N, HASHES, STEP, TOLERANCE, BLOCK, FEW = 5, 128, 16, 1e-7, 256, 1 << 18
#: Similarity as a fraction: 4/5.
OVER, UNDER = 4, 5
_seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * WORD)
MULTIPLY, ADD = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def least_matches(n: int, threshold: float = OVER / UNDER, tolerance: float = TOLERANCE) -> int:
    """The least number of matches among n values at which the posterior of reaching the threshold is not below tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


LEAST = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}


def grams(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes and their rows, ascending by row and hash."""
    starts, ends, rows = words_of(data, offsets)
    h = span_hashes(data, starts, ends)
    out, at = windows_of(h, rows, n)
    out, where = [out], [rows[at]]
    size = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.searchsorted(rows, np.arange(len(size)))
    for k in range(1, n):  # short texts: all their words
        short = np.flatnonzero(size == k)
        g = np.full(len(short), k, np.uint64)
        for i in range(k):
            g = g * WORD + h[first[short] + i]
        out.append(mixed(g))
        where.append(short)
    out, where = np.concatenate(out), np.concatenate(where)
    order = np.lexsort((out, where))
    out, where = out[order], where[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (where[1:] != where[:-1])
    return out[new], where[new]


def signatures(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, a row for each run of hashes that begins at a head."""
    out = np.empty((len(heads), HASHES), np.uint16)
    for k in range(HASHES if len(heads) else 0):
        out[:, k] = mixed(np.minimum.reduceat(h * MULTIPLY[k] + ADD[k], heads)) >> np.uint64(48)
    return out


def _sketches(batches):
    for part, data, offsets in text_blocks(batches, "text"):
        n = len(offsets) - 1
        h, rows = grams(data, offsets)
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
        sig = signatures(h, heads)
        keys, sizes = np.zeros(n, np.uint64), np.bincount(rows, minlength=n)
        if len(heads):
            keys[rows[heads]] = mixed(np.add.reduceat(mixed(h), heads) + sizes[rows[heads]].astype(np.uint64))
        get = lambda c: part.column(part.schema.get_field_index(c))
        values = lists(sig.view(np.int64).ravel(), np.repeat(rows[heads], HASHES // 4), n, pa.int64())
        yield pa.RecordBatch.from_arrays([get("doc_id"), get("text_key"), pa.array(long_view(keys)), pa.array(sizes, pa.int32()), values], ["doc_id", "text_key", "set_id", "n_grams", "signature"])


def _groups(batches, keys: list[str]):
    """Record batches of whole groups of rows that agree in keys; rows come sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        cols = [np.asarray(t[k]) for k in keys]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        if len(cut):
            yield t.slice(0, cut[-1]).combine_chunks(), np.concatenate([[0], cut])
            rest = t.slice(cut[-1]).combine_chunks()
        else:
            rest = t
    if rest is not None and rest.num_rows:
        cols = [np.asarray(rest[k]) for k in keys]
        new = np.ones(rest.num_rows, bool)
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        yield rest.combine_chunks(), np.append(np.flatnonzero(new), rest.num_rows)


def _pairs(heads: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int = 1 << 20):
    """Index pairs (a < b) within each group; in a group of two blocks only those across. In chunks."""
    a_all, b_all, held = [], [], 0
    sizes = np.diff(heads)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
        first = heads[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        for k in range(0, len(first), max(1, most // len(i))):
            f = first[k : k + max(1, most // len(i)), None]
            a, b = (f + i).ravel(), (f + j).ravel()
            ok = ~cross[a] | (side[a] != side[b])
            yield a[ok], b[ok]
    for g in np.flatnonzero(sizes > 32):
        s, e = heads[g], heads[g + 1]
        for a in range(s, e - 1):
            b = np.arange(a + 1, e)
            if cross[a]:
                b = b[side[b] != side[a]]
            a_all.append(np.full(len(b), a))
            b_all.append(b)
            held += len(b)
            if held > most:
                yield np.concatenate(a_all), np.concatenate(b_all)
                a_all, b_all, held = [], [], 0
    if held:
        yield np.concatenate(a_all), np.concatenate(b_all)


def _survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The pairs whose posterior stays above the tolerance through all values."""
    same = np.zeros(len(a), np.int32)
    for n in range(STEP, sig.shape[1] + 1, STEP):
        same += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(1, dtype=np.int32)
        ok = same >= LEAST[n]
        a, b, same = a[ok], b[ok], same[ok]
    return a, b


def _least_ids(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the least id among the rows that pairs (a, b) of rows connect it to."""
    label = np.arange(len(ids))
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    least = ids.copy()
    np.minimum.at(least, label, ids)
    return least[label]


def _linked(batches):
    """Rows (bucket, low, high, side, set_id, values) to edges (a, b) of the buckets' forests."""
    for t, heads in _groups(batches, ["bucket", "low", "high"]):
        sig = np.asarray(t["values"].combine_chunks().flatten()).reshape(t.num_rows, -1).view(np.uint16)
        side, cross = np.asarray(t["side"]), np.asarray(t["low"]) != np.asarray(t["high"])
        found = [_survivors(sig, a, b) for a, b in _pairs(heads, side, cross)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        ids = np.asarray(t["set_id"])
        least = _least_ids(ids, a, b)
        at = np.flatnonzero(least != ids)
        edges = np.unique(np.stack([ids[at], least[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _exact(h: np.ndarray, heads: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the gram sets of each pair; sets are slices of h."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(h[heads[i] : heads[i + 1]], h[heads[j] : heads[j + 1]], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    rows, to = np.unique(np.concatenate([a, b]), return_inverse=True)
    size = heads[rows + 1] - heads[rows]
    of = np.repeat(np.arange(len(rows)), size)
    own = np.concatenate([h[heads[r] : heads[r + 1]] for r in rows])
    ids = np.unique(own, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    ids, of = ids[order], of[order]
    met = np.zeros((len(rows), len(rows)), np.float32)
    for first in range(0, int(ids[-1]) + 1, 4096):
        s, e = np.searchsorted(ids, [first, first + 4096])
        dense = np.zeros((len(rows), 4096), np.float32)
        dense[of[s:e], ids[s:e] - first] = 1
        met += dense @ dense.T
    return met[to[: len(a)], to[len(a) :]].astype(np.int64)


def _verified(batches):
    """Rows (grp, low, high, side, set_id, copies, grams) to links and forest edges: (set_id, links, copies linked, root)."""
    for whole, bounds in _groups(batches, ["grp", "low", "high"]):
        for g in range(len(bounds) - 1):
            t = whole.slice(bounds[g], bounds[g + 1] - bounds[g]).combine_chunks()
            n = t.num_rows
            col = t["grams"].combine_chunks()
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            offsets = np.asarray(col.offsets).astype(np.int64)
            h = np.asarray(col.values).view(np.uint64)[offsets[0] : offsets[-1]]
            heads = offsets - offsets[0]
            sig, size = signatures(h, heads[:-1]), np.diff(heads)
            side, cross = np.asarray(t["side"]), np.asarray(t["low"]) != np.asarray(t["high"])
            found = []
            for a, b in _pairs(np.array([0, n]), side, cross):
                a, b = _survivors(sig, a, b)
                met = _exact(h, heads, a, b)
                ok = met * UNDER >= (size[a] + size[b] - met) * OVER
                found.append((a[ok], b[ok]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
            ids, copies = np.asarray(t["set_id"]), np.asarray(t["copies"])
            least = _least_ids(ids, a, b)
            links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            others = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at], pa.int64()), pa.array(others[at].astype(np.int64)), pa.array(least[at])], ["set_id", "links", "others", "root"])


def _blocked(members: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """Deals the members of each key to pairs of blocks: adds low, high, side."""
    n = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit("block")), n).cast("int")
    dealt = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other", count)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, set_id, n_grams, signature) of each document, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return stored(rows.mapInArrow(_sketches, "doc_id long, text_key long, set_id long, n_grams int, signature array<long>"), "sketches")


def links(docs: DataFrame, rows: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(set_id, links, others, roots): exact links of each class that has any. rows: sketched(docs).

    One document of each set that has candidates is chosen before texts are fetched: by a broadcast of the
    chosen ids where they are at most few, else by a join. Either gives the same rows.
    """
    place = F.struct("text_key", "doc_id")
    classes = rows.where("n_grams > 0").groupBy("set_id").agg(F.any_value("signature").alias("signature"), F.count("*").alias("copies"), F.min(place).alias("place"))
    classes = stored(classes, "classes")
    members = classes.select("set_id", F.posexplode("signature").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "set_id")
    n_classes = classes.count()
    sizes = stored(members.groupBy("bucket").count().where("count > 1"), "buckets")
    first = classes.select("set_id", F.slice("signature", 1, HASHES // 8).alias("values"))
    met = _blocked(met_by(members, sizes, "bucket", "count", n_classes * HASHES // 4), "bucket", "count", block).join(first, "set_id")
    place = ["bucket", "low", "high"]
    edges = met.select(*place, "side", "set_id", "values").repartition(*place).sortWithinPartitions(*place).mapInArrow(_linked, "a long, b long").distinct()
    labels = components(edges)
    group = labels.select(F.col("node").alias("set_id"), F.col("label").alias("grp"))
    counted = met_by(group, group.groupBy("grp").count(), "grp", "count", n_classes)
    wanted = stored(counted.join(classes.select("set_id", "copies", "place"), "set_id"), "wanted")
    chosen = wanted.select("set_id", "place.text_key", F.col("place.doc_id").alias("id"))
    if wanted.count() <= few:
        chosen = F.broadcast(chosen)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    texts = keyed.join(chosen, (keyed.text_key == chosen.text_key) & keyed.doc_id.eqNullSafe(chosen.id)).dropDuplicates(["set_id"])
    sets = texts.select("set_id", "text").mapInArrow(_gram_lists, "set_id long, grams array<long>")
    place = ["grp", "low", "high"]
    full = _blocked(wanted.join(sets, "set_id"), "grp", "count", block).select(*place, "side", "set_id", "copies", "grams")
    out = full.repartition(*place).sortWithinPartitions(*place).mapInArrow(_verified, "set_id long, links long, others long, root long")
    out = stored(out.groupBy("set_id").agg(F.sum("links").alias("links"), F.sum("others").alias("others"), F.collect_set("root").alias("roots")), "links")
    for table in (classes, sizes, labels, wanted):
        discard(table)
    return out


def _gram_lists(batches):
    for part, data, offsets in text_blocks(batches, "text"):
        h, rows = grams(data, offsets)
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("set_id")), lists(long_view(h), rows, len(offsets) - 1, pa.int64())], ["set_id", "grams"])


def joined(docs: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """One row per document: doc_id, text_key, class_id (least doc_id of all that links and copies connect), set_id (texts of
    equal gram sets), n_links (other documents at or over the threshold), n_set_links (other gram sets), n_grams, first
    (whether it is the document of its class that stays)."""
    rows = sketched(docs)
    found = links(docs, rows, block, few)
    groups = components(found.select(F.col("set_id").alias("a"), F.explode("roots").alias("b"))).select(F.col("node").alias("set_id"), "label")
    alone = F.col("n_grams") == 0
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = rows.where(~alone).groupBy("set_id").agg(F.count("*").alias("copies"), F.min(who).alias("least"))
    sets = sets.join(found.drop("roots"), "set_id", "left").join(groups, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    sets = stored(sets, "sets")
    classes = sets.groupBy("label").agg(F.count("*").alias("members"), F.min("least").alias("who"))
    named = met_by(sets, classes, "label", "members", sets.count())
    named = stored(named.select("set_id", "copies", "who", "links", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "sets")
    discard(sets)
    slim = rows.select("doc_id", "text_key", "set_id", "n_grams")
    out = met_by(slim.where(~alone), named, "set_id", "copies", rows.count())
    linked = out.select("doc_id", "text_key", F.col("who.doc_id").alias("class_id"), "set_id", "n_links", F.coalesce("links", F.lit(0)).alias("n_set_links"), "n_grams", F.col("who").eqNullSafe(who).alias("first"))
    return linked.unionByName(slim.where(alone).select("doc_id", "text_key", F.col("doc_id").alias("class_id"), "set_id", F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_set_links"), "n_grams", F.lit(True).alias("first")))


def thinned(docs: DataFrame) -> DataFrame:
    """One document of each class (doc_id, text, lang, source, n_chars): that of the least id, one of rows that repeat. Texts without a word all stay."""
    ids = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key"]
    place = ["id", "no_id", "text_key"]
    keep = joined(docs).where("first").select(*ids)
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.when(wordless, F.monotonically_increasing_id()).otherwise(-1).alias("row"))
    met = keyed.select("*", *ids[:2]).join(keep, place, "left_semi")
    return met.dropDuplicates([*place, "row"]).drop(*place, "row")  # rows that repeat lie where the join has put them


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_set_links", "n_grams")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_sort(list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])) END AS g FROM d),
c AS (SELECT g, min(r) AS c, min(doc_id) AS lowest, count(*) AS copies, len(g) AS n FROM s GROUP BY g),
x AS (SELECT c, n, copies, unnest(g) AS gram FROM c),
p AS (SELECT a.c AS a, b.c AS b, any_value(b.copies) AS copies, count(*) AS met, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM x a JOIN x b ON a.gram = b.gram AND a.c <> b.c AND a.n * 4 <= b.n * 5 AND b.n * 4 <= a.n * 5 GROUP BY a.c, b.c),
e AS (SELECT a, b, copies FROM p WHERE met * 5 >= (na + nb - met) * 4),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
k AS (SELECT reach.a AS c, min(c.lowest) AS class_id FROM reach JOIN c ON c.c = reach.b GROUP BY reach.a),
l AS (SELECT a AS c, sum(copies) AS others, count(*) AS links FROM e GROUP BY a)
SELECT s.doc_id, CASE WHEN c.n = 0 THEN s.doc_id ELSE k.class_id END AS class_id,
       (CASE WHEN c.n = 0 THEN 0 ELSE coalesce(l.others, 0) + c.copies - 1 END)::BIGINT AS n_links, coalesce(l.links, 0)::BIGINT AS n_set_links, c.n::INT AS n_grams
FROM s JOIN c ON c.g = s.g JOIN k ON k.c = c.c LEFT JOIN l ON l.c = c.c
"""
