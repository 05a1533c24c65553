"""Language-model scores by an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark: tasks count the tokens, and then the bigrams, of their own documents
into sorted arrays, send these by shard, and the shards add them up. The model lies in the folder of
spark.checkpoint.dir as one set of sorted arrays for each shard (tokens and their hashes, counts,
continuation counts, totals and counts-of-counts of contexts, bigram keys and counts); workers map
these files into memory and look up each block's distinct tokens and bigrams in sorted order. A
token's id is its place among all tokens by hash and then bytes; a bigram's key is the two ids.

Hashes only order tokens: whether two are the same is told by their bytes, wherever tokens are counted
or looked up, so that words of one hash (the hash is a polynomial modulo 2^64, for which there are
such words of 1024 bytes) stay apart. The end of text has no bytes.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end of text; the first token's
context is the beginning of the text. Unknown tokens have a share of the lower order's smoothed mass;
after an unknown context the lower order alone decides.

The pairs at the beginning of texts, which share one context, are dealt to shards by their second
token; the context's numbers, which are few, go with what scored() needs.

Files are written under another name and then renamed, so that a task that is run again, or twice,
leaves the same model. Where the folder isn't a file: path, workers copy shards to temporary files
without a name first, which end with the worker.

Defined results: a null text is empty and has the end token only; rows that repeat count each; a null
id counts as the empty text for the fold, ids keep their type; without training documents every probability is 1 and every
score 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, remainder, scratch, span_hashes, stored, text_blocks, words_of

#: Bits of the least number of shards, and tokens that a task counts at a time.
BITS, CHUNK = 6, 1 << 22
END = np.uint64(0xE2D0FE2D0FE2D0F1)
ROW = "kind string, shard int, keys binary, counts binary"
#: Bytes that follow texts, so that eight can be read at any place; the lowest 0 to 8 bytes of a number.
PAD = np.zeros(8, np.uint8)
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_open: dict = {}


class Store:
    """Arrays as files in a folder of the cluster's shared store."""

    def __init__(self, folder: str):
        url = urlparse(folder)
        self.local = unquote(url.path) if url.scheme in ("", "file") else None
        self.folder = folder

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def save(self, name: str, values: np.ndarray) -> None:
        other = f"{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            values.tofile(f"{self.local}/{other}")
            os.replace(f"{self.local}/{other}", f"{self.local}/{name}")
            return
        store, path = self._remote()
        with store.open_output_stream(f"{path}/{other}") as f:
            f.write(np.ascontiguousarray(values).tobytes())
        store.move(f"{path}/{other}", f"{path}/{name}")

    def load(self, name: str, kind) -> np.ndarray:
        """The array, mapped into memory; empty if there is no such file."""
        key = self.folder, name
        if key not in _open:
            if self.local is None:
                store, at = self._remote()
                path = tempfile.TemporaryFile()
                if store.get_file_info(f"{at}/{name}").is_file:
                    with store.open_input_stream(f"{at}/{name}") as src:
                        while part := src.read(1 << 22):
                            path.write(part)
                path.flush()
                size = path.tell()
            else:
                path = f"{self.local}/{name}"
                size = os.path.getsize(path) if os.path.exists(path) else 0
            _open[key] = np.asarray(np.memmap(path, kind, "r")) if size else np.zeros(0, kind)
        return _open[key]


def _packed(values: np.ndarray) -> bytes:
    """Ascending or small numbers, differences compressed; the length comes first."""
    data = np.diff(values, prepend=values.dtype.type(0)) if values.dtype == np.uint64 else values
    raw = np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    data = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)
    return np.cumsum(data, dtype=np.uint64) if kind == np.uint64 else data


class Tokens:
    """Tokens by their hashes and places in padded lower-case bytes."""

    def __init__(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.hashes, self.data, self.starts, self.sizes = hashes, data, starts, sizes

    def __len__(self) -> int:
        return len(self.hashes)

    def take(self, at) -> Tokens:
        return Tokens(self.hashes[at], self.data, self.starts[at], self.sizes[at])

    def alone(self) -> Tokens:
        """The same with no more bytes than their own."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        return Tokens(self.hashes, np.append(self.data[np.repeat(self.starts - starts, self.sizes) + np.arange(ends[-1] if len(ends) else 0)], PAD), starts, self.sizes)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes()


def _joined(parts: list[Tokens]) -> Tokens:
    shift = np.cumsum([0] + [len(p.data) for p in parts]).tolist()
    starts = [p.starts + s for p, s in zip(parts, shift[:-1], strict=True)]
    return Tokens(np.concatenate([p.hashes for p in parts]), np.concatenate([p.data for p in parts]), np.concatenate(starts), np.concatenate([p.sizes for p in parts]))


def _equal(a: Tokens, i: np.ndarray, b: Tokens, j: np.ndarray) -> np.ndarray:
    """Whether the tokens of a at i have the bytes of those of b at j: eight at a time, those beyond 64 at once."""
    out = a.sizes[i] == b.sizes[j]
    at = np.flatnonzero(out & (a.sizes[i] > 0))
    if not len(at):
        return out
    x, y = (np.ndarray(len(t.data) - 7, np.uint64, t.data, strides=(1,)) for t in (a, b))
    left, s, t = a.sizes[i[at]], a.starts[i[at]], b.starts[j[at]]
    for k in range(0, 64, 8):
        found = ((x[s + k] ^ y[t + k]) & LOW[np.minimum(left, 8)]) == 0
        out[at[~found]] = False
        more = np.flatnonzero(found & (left > 8))
        at, left, s, t = at[more], left[more] - 8, s[more], t[more]
        if not len(at):
            return out
    for k in at.tolist():
        out[k] = a.word(i[k]) == b.word(j[k])
    return out


def _sorted(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The order of the tokens by hash and then bytes, and whether a token differs from the one before."""
    order = np.argsort(tokens.hashes)
    hashes = tokens.hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    at = np.flatnonzero(~new)
    same = _equal(tokens, order[at], tokens, order[at - 1])
    if not same.all():  # other words of the same hash
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(order))
        for g in np.unique(np.searchsorted(heads, at[~same], "right") - 1).tolist():
            s, e = int(heads[g]), int(ends[g])
            words = sorted((tokens.word(k), k) for k in order[s:e].tolist())
            order[s:e] = [k for _, k in words]
            new[s + 1 : e] = [x[0] != y[0] for x, y in zip(words[1:], words[:-1], strict=True)]
    return order, new


def _distinct(tokens: Tokens, counts: np.ndarray | None = None) -> tuple[Tokens, np.ndarray]:
    """Distinct tokens in order, with bytes of their own, and their counts (or the sums of theirs)."""
    order, new = _sorted(tokens)
    heads = np.flatnonzero(new)
    total = np.diff(np.append(heads, len(order))) if counts is None else (np.add.reduceat(counts[order], heads) if len(heads) else counts)
    return tokens.take(order[heads]).alone(), total.astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens of the rows (words, then the end), the rows' first places, and whether a token is its row's first."""
    starts, ends, rows = words_of(data, offsets)
    n = len(offsets) - 1
    at = np.arange(len(starts)) + rows
    low = np.append(LOWER[data], PAD)
    out = Tokens(np.full(len(starts) + n, END, np.uint64), low, *np.zeros((2, len(starts) + n), np.int64))
    out.hashes[at], out.starts[at], out.sizes[at] = span_hashes(low[: len(data)], starts, ends), starts, ends - starts
    heads = np.searchsorted(rows, np.arange(n)) + np.arange(n)
    first = np.zeros(len(out), bool)
    first[heads] = True
    return out, heads, first


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts (or the sums of theirs)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    total = np.diff(np.append(heads, len(keys))) if counts is None else (np.add.reduceat(counts[order], heads) if len(heads) else counts)
    return keys[heads], total.astype(np.int64)


def _packed_words(tokens: Tokens, s: int, e: int) -> bytes:
    """The tokens s to e, which lie one after another: their sizes, then their bytes. Hashes follow from the bytes."""
    data = tokens.data[tokens.starts[s] : tokens.starts[e - 1] + tokens.sizes[e - 1]]
    sizes = _packed(tokens.sizes[s:e].astype(np.uint32))
    return len(sizes).to_bytes(8, "little") + sizes + _packed(data)


def _unpacked_words(blob: bytes) -> Tokens:
    cut = 8 + int.from_bytes(blob[:8], "little")
    sizes, data = _unpacked(blob[8:cut], np.uint32).astype(np.int64), np.append(_unpacked(blob[cut:], np.uint8), PAD)
    ends = np.cumsum(sizes)
    return Tokens(np.where(sizes > 0, span_hashes(data[:-8], ends - sizes, ends), END), data, ends - sizes, sizes)


def _rows(kind: str, shards: np.ndarray, keys: np.ndarray | Tokens, counts: np.ndarray):
    """A batch with a row for each shard; keys come ascending by shard."""
    heads = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(keys) else np.zeros(0, int)
    ends = np.append(heads[1:], len(keys))[: len(heads)]
    small = np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.int64
    packed = (lambda s, e: _packed_words(keys, s, e)) if isinstance(keys, Tokens) else (lambda s, e: _packed(keys[s:e]))
    parts = [(kind, int(shards[s]), packed(s, e), bytes([small is np.int64]) + _packed(counts[s:e].astype(small))) for s, e in zip(heads, ends, strict=True)]
    cols = list(zip(*parts, strict=True)) if parts else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "shard", "keys", "counts"])


def _merged(batches, unpacked=lambda keys: _unpacked(keys, np.uint64), joined=np.concatenate, counted=_counted):
    """(shard, keys, counts) of rows sorted by shard."""
    added = lambda keys, counts: counted(joined(keys), np.concatenate(counts))
    held, at = [], None
    for b in batches:
        for shard, keys, counts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "keys", "counts")), strict=True):
            if shard != at and held:
                yield at, *added(*zip(*held, strict=True))
                held = []
            at = shard
            held.append((unpacked(keys), _unpacked(counts[1:], np.int64 if counts[0] else np.uint32).astype(np.int64)))
    if held:
        yield at, *added(*zip(*held, strict=True))


def _stats(shard: int, *numbers: int, kind: str = "stats"):
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([shard], pa.int32()), pa.array([np.array(numbers, np.int64).tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["kind", "shard", "keys", "counts"])


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _unigrams(bits: int):
    def run(batches):
        held, n = [], 0

        def out():
            parts, counts = zip(*held, strict=True)
            words, counts = _distinct(_joined(parts), np.concatenate(counts))
            return _rows("token", (words.hashes >> np.uint64(64 - bits)).astype(np.int64), words, counts)

        for _, data, offsets in text_blocks(batches, "text", 1 << 22):
            tokens = _tokens(data, offsets)[0]
            held.append(_distinct(tokens))
            n += len(tokens) + (len(held[-1][0].data) >> 3)
            if n > CHUNK:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def _save_unigrams(folder: str):
    def run(batches):
        store = Store(folder)
        for shard, words, counts in _merged(batches, _unpacked_words, _joined, _distinct):
            store.save(f"token-{shard}", words.hashes)
            store.save(f"word-{shard}", words.data)
            store.save(f"start-{shard}", np.append(words.starts, len(words.data) - len(PAD)))
            store.save(f"count-{shard}", counts)
            yield _stats(shard, len(words), int(counts.sum()))

    return run


class Model:
    """Reads what train() wrote; bases: the first id of each shard, and the number of all ids at the end."""

    def __init__(self, folder: str, bits: int, bases: list[int]):
        self.store, self.bits, self.bases = Store(folder), bits, np.array(bases, np.int64)
        self.size = int(bases[-1])

    def by_shard(self, shards: np.ndarray):
        if not len(shards):
            return iter(())
        heads = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        return zip(shards[heads].tolist(), heads.tolist(), np.append(heads[1:], len(shards)).tolist(), strict=True)

    def ids(self, tokens: Tokens) -> np.ndarray:
        """Ids of distinct tokens in order; -1: unknown. Words of one hash are tried one after another."""
        out = np.full(len(tokens), -1, np.int64)
        for shard, s, e in self.by_shard((tokens.hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            keys = self.store.load(f"token-{shard}", np.uint64)
            starts = self.store.load(f"start-{shard}", np.int64)
            hashes = tokens.hashes[s:e]
            k = np.searchsorted(keys, hashes)
            at = np.arange(e - s)
            while len(at := at[k[at] < len(keys)]) and len(at := at[keys[k[at]] == hashes[at]]):
                known = Tokens(keys[k[at]], self.store.load(f"word-{shard}", np.uint8), starts[k[at]], starts[k[at] + 1] - starts[k[at]])
                found = _equal(tokens, at + s, known, np.arange(len(at)))
                out[at[found] + s] = k[at[found]] + self.bases[shard]
                at = at[~found]
                k[at] += 1
        return out

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        """The shard of each id."""
        return np.searchsorted(self.bases, ids, "right") - 1

    def shard_of_pairs(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each bigram key: that of its first token; at the beginning of texts, whose id is the number of tokens, others, by the second token."""
        before, ids = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return np.where(before >= self.size, (1 << self.bits) + self.shard_of(ids), self.shard_of(before))

    def gather(self, name: str, ids: np.ndarray, kind=np.int64, shape: int = 1) -> np.ndarray:
        """Values that lie by id; ids ascending, -1 and the beginning of texts give 0."""
        out = np.zeros((len(ids), shape), kind)
        first, end = np.searchsorted(ids, [0, self.size]).tolist()
        for shard, s, e in self.by_shard(self.shard_of(ids[first:end])):
            values = self.store.load(f"{name}-{shard}", kind).reshape(-1, shape)
            if len(values):
                out[first + s : first + e] = values[ids[first + s : first + e] - self.bases[shard]]
        return out[:, 0] if shape == 1 else out

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct ascending bigram keys."""
        out = np.zeros(len(keys), np.int64)
        for shard, s, e in self.by_shard(self.shard_of_pairs(keys)):
            known = self.store.load(f"pair-{shard}", np.uint64)
            if len(known):
                counts = self.store.load(f"paircount8-{shard}", np.int64)
                counts = counts if len(counts) else self.store.load(f"paircount-{shard}", np.uint32)
                k = np.minimum(np.searchsorted(known, keys[s:e]), len(known) - 1)
                out[s:e] = np.where(known[k] == keys[s:e], counts[k], 0)
        return out

    def pairs(self, data: np.ndarray, offsets: np.ndarray):
        """Token ids, ids of their contexts, and the rows' first places."""
        tokens, heads, first = _tokens(data, offsets)
        order, new = _sorted(tokens)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        own = self.ids(tokens.take(order[new]))
        ids = own[back]
        before = np.concatenate([[-1], ids[:-1]])
        before[first] = self.size
        return ids, before, heads, (own, back)


def _bigrams(args):
    def run(batches):
        model = Model(*args)
        held, n = [], 0

        def out():
            keys, counts = _counted(np.concatenate(held))
            return _rows("pair", model.shard_of_pairs(keys), keys, counts)

        for _, data, offsets in text_blocks(batches, "text", 1 << 22):
            ids, before, _, _ = model.pairs(data, offsets)
            held.append((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
            n += len(ids)
            if n > CHUNK:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def _save_bigrams(args):
    def run(batches):
        model = Model(*args)
        for shard, keys, counts in _merged(batches):
            begin = shard >> model.bits
            base = model.size if begin else int(model.bases[shard])
            n = 1 if begin else int(model.bases[shard + 1]) - base
            context = (keys >> np.uint64(32)).astype(np.int64) - base
            table = np.zeros((n, 4), np.int64)  # total, and how many counts are 1, 2, more
            np.add.at(table[:, 0], context, counts)
            np.add.at(table, (context, np.minimum(counts, 3)), 1)
            model.store.save(f"pair-{shard}", keys)
            large = len(counts) and counts.max() >= 1 << 32
            model.store.save(f"paircount8-{shard}" if large else f"paircount-{shard}", counts if large else counts.astype(np.uint32))
            if begin:
                yield _stats(shard, *table[0].tolist(), kind="begin")
            else:
                model.store.save(f"context-{shard}", table)
            yield _stats(shard, len(keys), *_of_counts(counts))
            after, kinds = _counted(keys & np.uint64(0xFFFFFFFF))
            yield _rows("after", model.shard_of(after.astype(np.int64)), after, kinds)

    return run


def _save_continuations(args):
    def run(batches):
        model = Model(*args)
        for shard, keys, counts in _merged(batches):
            values = np.zeros(int(model.bases[shard + 1] - model.bases[shard]), np.int64)
            values[keys.astype(np.int64) - model.bases[shard]] = counts
            model.store.save(f"after-{shard}", values)
            yield _stats(shard, int(counts.sum()), *_of_counts(counts), int((counts >= 3).sum()))

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2, more, from how many counts are 1, 2, 3, 4; halves where these don't give any."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def train(docs: DataFrame, tag: str = "lm") -> dict:
    """Count the texts of docs and write the model; returns what scored() needs (small numbers only)."""
    spark = docs.sparkSession
    docs = docs.select("text")
    bits = max(BITS, (docs.rdd.getNumPartitions() // 2).bit_length())
    folder = scratch(spark, tag)
    by_shard = lambda df: df.repartition("shard").sortWithinPartitions("shard")
    numbers = lambda df, kind="stats": {r.shard: np.frombuffer(r.keys, np.int64).tolist() for r in df.where(F.col("kind") == kind).select("shard", "keys").collect()}
    sizes = numbers(by_shard(docs.mapInArrow(_unigrams(bits), ROW)).mapInArrow(_save_unigrams(folder), ROW))
    bases = np.cumsum([0] + [sizes.get(s, [0])[0] for s in range(1 << bits)]).tolist()
    if bases[-1] >= 1 << 32:
        raise ValueError("more than 2^32 distinct tokens")
    args = (folder, bits, bases)
    pairs = stored(by_shard(docs.mapInArrow(_bigrams(args), ROW)).mapInArrow(_save_bigrams(args), ROW), "after")
    of_pairs, begin = numbers(pairs), numbers(pairs, "begin")
    of_after = numbers(by_shard(pairs.where("kind = 'after'")).mapInArrow(_save_continuations(args), ROW))
    discard(pairs)
    added = lambda x, k: sum(v[k] for v in x.values())
    return {
        "args": args, "tokens": added(sizes, 1), "begin": [added(begin, k) for k in range(4)], "pairs": added(of_pairs, 0), "high": discounts([added(of_pairs, k) for k in range(1, 5)]),
        "low": discounts([added(of_after, k) for k in range(1, 5)]), "low_counts": [added(of_after, 1), added(of_after, 2), added(of_after, 5)],
    }


def probabilities(m: dict, count, after, pair, context) -> np.ndarray:
    """P(token | context) of each token: its count and continuation count, the bigram's count, the context's numbers."""
    size = m["args"][2][-1]
    d = np.array([0.0, *m["low"]])
    if m["pairs"]:
        spare = float(np.dot(m["low"], m["low_counts"])) / m["pairs"]
        low = np.maximum(after - d[np.minimum(after, 3)], 0) / m["pairs"] + spare / (size + 1)
    else:
        low = np.full(len(count), 1.0 / (size + 1))
    d = np.array([0.0, *m["high"]])
    total = context[:, 0]
    high = (np.maximum(pair - d[np.minimum(pair, 3)], 0) + context[:, 1:] @ d[1:] * low) / np.maximum(total, 1)
    return np.where(total > 0, high, low)


def _score(m: dict):
    size, n = m["args"][2][-1], m["tokens"]

    def run(batches):
        model = Model(*m["args"])
        for part, data, offsets in text_blocks(batches, "text", 1 << 22):
            ids, before, heads, (own, back) = model.pairs(data, offsets)
            order = np.argsort(own, kind="stable")
            count, after = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            count[order], after[order] = model.gather("count", own[order]), model.gather("after", own[order])
            known = (ids >= 0) & (before >= 0)
            keys, at = np.unique((before[known].astype(np.uint64) << np.uint64(32)) | ids[known].astype(np.uint64), return_inverse=True)
            pair = np.zeros(len(ids), np.int64)
            pair[known] = model.bigrams(keys)[at]
            contexts, where = np.unique(before, return_inverse=True)
            context = model.gather("context", contexts, shape=4)
            context[contexts == size] = m["begin"]
            context = context[where]
            p = np.log10(probabilities(m, count[back], after[back], pair, context))
            base = np.log10((count[back] + 0.1) / (n + 0.1 * (size + 1)))
            total = lambda x: np.add.reduceat(x, heads)  # noqa: B023, E731
            get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            tokens, score = np.diff(np.append(heads, len(ids))), total(p)
            values = [(tokens, pa.int64()), (total((count[back] > 0).astype(np.int64)), pa.int64()), (np.full(len(heads), n), pa.int64()), (total(base), pa.float64()), (score, pa.float64()), (10 ** np.minimum(-score / tokens, 300), pa.float64())]
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("held_out"), *(pa.array(v, k) for v, k in values)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of rows (doc_id, held_out, text)."""
    docs = docs.select("doc_id", "held_out", "text")
    return docs.mapInArrow(_score(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remainder("doc_id", 10) == 0
    found = scored(docs.select("doc_id", out.alias("held_out"), "text"), train(docs.where(~out)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"), F.round("score", 4).alias("score"))


#: crc32 as SQL: the eight shifts of a byte, over the bytes of the id's digits.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(coalesce(doc_id::VARCHAR, ''), '') IF x <> '']), lambda a, b: {})"
_STEP = "xor(a, b)"
for _ in range(8):
    _STEP = f"[xor(z >> 1, (z & 1) * 3988292384) FOR z IN [{_STEP}]][1]"
CRC32 = f"xor({_CRC.format(_STEP)}, 4294967295)"

_DISCOUNT = "CASE WHEN least(n1, n2, n3, n4) > 0 THEN greatest(0.0, least({k}.0, {k} - {k1} * (n1 / (n1 + 2.0 * n2)) * n{k1} / n{k})) ELSE {k} * 0.5 END"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {CRC32} % 10 = 0 AS held_out,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, held_out, i, CASE WHEN i <= len(w) THEN w[i] ELSE chr(10) END AS w, CASE WHEN i = 1 THEN chr(9) ELSE w[i - 1] END AS u
      FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM d)),
uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*)::DOUBLE AS v FROM uni),
bi AS (SELECT u, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, w),
hc AS (SELECT count_if(c = 1)::DOUBLE AS n1, count_if(c = 2)::DOUBLE AS n2, count_if(c = 3)::DOUBLE AS n3, count_if(c = 4)::DOUBLE AS n4, count(*)::DOUBLE AS pairs FROM bi),
h AS (SELECT pairs, {_DISCOUNT.format(k=1, k1=2)} AS d1, {_DISCOUNT.format(k=2, k1=3)} AS d2, {_DISCOUNT.format(k=3, k1=4)} AS d3 FROM hc),
ctx AS (SELECT u, sum(c)::DOUBLE AS total, count_if(c = 1) AS m1, count_if(c = 2) AS m2, count_if(c > 2) AS m3 FROM bi GROUP BY u),
aft AS (SELECT w, count(*) AS c FROM bi GROUP BY w),
lc AS (SELECT count_if(c = 1)::DOUBLE AS n1, count_if(c = 2)::DOUBLE AS n2, count_if(c = 3)::DOUBLE AS n3, count_if(c = 4)::DOUBLE AS n4, count_if(c > 2)::DOUBLE AS more FROM aft),
l AS (SELECT n1, n2, more, {_DISCOUNT.format(k=1, k1=2)} AS e1, {_DISCOUNT.format(k=2, k1=3)} AS e2, {_DISCOUNT.format(k=3, k1=4)} AS e3 FROM lc),
p AS (SELECT t.r, coalesce(uni.c, 0) AS c, coalesce(bi.c, 0) AS pair, total, m1 * d1 + m2 * d2 + m3 * d3 AS spare, d1, d2, d3, n, v,
      greatest(0.0, coalesce(aft.c, 0) - CASE coalesce(aft.c, 0) WHEN 0 THEN 0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END) / pairs + (n1 * e1 + n2 * e2 + more * e3) / pairs / (v + 1) AS low
      FROM t CROSS JOIN n CROSS JOIN h CROSS JOIN l LEFT JOIN uni ON uni.w = t.w LEFT JOIN aft ON aft.w = t.w LEFT JOIN bi ON bi.u = t.u AND bi.w = t.w LEFT JOIN ctx ON ctx.u = t.u),
q AS (SELECT r, c, log10((c + 0.1) / (n + 0.1 * (v + 1))) AS base,
      log10(CASE WHEN total IS NULL THEN low ELSE (greatest(0.0, pair - CASE pair WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) + spare * low) / total END) AS s, n FROM p)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count_if(c > 0)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(base), 4) AS base_score, round(sum(s), 4) AS score
FROM q JOIN d USING (r) GROUP BY r, doc_id, held_out
"""
