"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two words counts their common subsequences of three characters, each weighted with
DECAY for every character skipped (spans of at most SPAN characters), and is normalised by the
weights of all subsequences of either word. So a word with a letter put in, left out or swapped
stays close to the word it comes from, and a word's kernel with itself is 1. Words are folded first:
lower case, accents and styles of letters off, common digit and sign substitutes to letters, other
signs dropped. Runs of successive words of at most GAPPED
letters are also joined, each run and each JOIN or fewer successive words of it to one more word (as is
each run of single letters), in training and scoring alike, so that a word gapped by blanks is met.

Labels are of documents, insults are words: toxic training documents name their most telling word
(at first by how often its letter groups occur in toxic and in clean documents, then by the machine
itself), clean ones give words as negatives, the hardest of each round among them. A word weighs as often as it is named, so that labels set in error, whose words nobody else names, count little. The machine is a
linear squared-hinge classifier in the Nystrom space of LANDMARKS words. As the kernel is an inner
product of subsequence counts, the decision function folds into one table of weights, one for each
triple of characters; a text is scored through this table in time linear in its length. The three
highest word margins and the text's length give the score by logistic regression.

Training takes at most ROWS labelled rows of each label, those of the lowest text hash, as many of
them as have WORDS distinct words in all (a text's words count once in each text), one at least; of
the rows taken, as of those scored, the whole text is read. POOL words of clean texts, those of the
lowest hash, and the HARD ones of the highest margins are the negatives of a round. The rows are of different texts: copies of a text count
once for each label, however many they are, so that no group of copies shuts other texts out.

Defined results: a null or empty text has the score of a text without a word; rows with a null label
are not learned from; documents with several labels are learned from with each; rows that repeat get
equal results each; without rows of both labels every score is 0; an empty table gives an empty
result; a null id counts as the empty text for the fold and joins no label; other columns are not
read.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, remainder, span_hashes, stored, text_blocks

ROWS, WORDS, POOL, HARD, LANDMARKS, DECAY, SPAN, ROUNDS, LEAST, FLOOR, TOP = 2000, 1 << 20, 8000, 4000, 256, 0.5, 4, 3, 3, -2.0, 2.0
GAPPED, JOIN, CHUNK, PART, LETTERS = 2, 8, 1 << 20, 1 << 17, 0x32400
OFFSETS = [(j, k) for k in range(2, SPAN + 1) for j in range(1, k)]
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_known: dict = {}


def _codes() -> np.ndarray:
    """For code points under LETTERS, beyond which there are no letters: 1-26 letters, 27-29 other letters, 30 digits, 31 dropped."""
    if "codes" not in _known:
        out = np.full(LETTERS, 31, np.uint8)
        for i in range(LETTERS):
            c = SUBSTITUTES.get(chr(i)) or unicodedata.normalize("NFKD", chr(i).lower())[:1].lower()
            if "a" <= c <= "z":
                out[i] = ord(c) - 96
            elif chr(i).isalpha():
                out[i] = 27 + i % 3
            elif chr(i).isdigit():
                out[i] = 30
        out[[9, 10, 11, 12, 13, 32]] = 0
        _known["codes"] = out
    return _known["codes"]


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a block of texts with one 0 before and after each word; places of the zeros before words; their rows."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = np.insert(_codes()[np.minimum(points, LETTERS - 1)], heads, 0)
    heads = heads + np.arange(len(heads))
    keep = codes != 31
    heads = np.concatenate([[0], np.cumsum(keep)])[heads]
    codes = codes[keep]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    keep[0] = True
    heads = np.concatenate([[0], np.cumsum(keep)])[heads]
    codes = codes[keep]
    zeros = np.flatnonzero(codes == 0)[:-1] if len(codes) > 1 else np.zeros(0, int)
    return codes, zeros, np.maximum(np.searchsorted(heads, zeros, "right") - 1, 0)


def triples(codes: np.ndarray):
    """For each of the spans: first places, codes of the triples there, weight; triples stay inside one word (and its two zeros)."""
    blank = np.concatenate([[0], np.cumsum(codes == 0)])
    for j, k in OFFSETS:
        n = len(codes) - k
        if n > 0:
            at = np.flatnonzero(blank[k : k + n] == blank[1 : n + 1])
            yield at, (codes[at].astype(np.int32) << 10) | (codes[at + j].astype(np.int32) << 5) | codes[at + k], DECAY ** (k - 2)


def weighed(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples of each word, their words (owner: a number for each place) and their weights, those of all occurrences summed."""
    found = [((owner[at].astype(np.int64) << 15) | triple, np.full(len(at), weight)) for at, triple, weight in triples(codes)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, weights = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[heads] & 0x7FFF, keys[heads] >> 15, np.add.reduceat(weights, heads) if len(heads) else np.zeros(0)


def margins(codes: np.ndarray, zeros: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The decision value of each word; FLOOR for those of fewer than LEAST letters. Words of a block that are equal are valued once."""
    if not len(zeros):
        return np.zeros(0)
    size = np.append(zeros[1:], len(codes) - 1) - zeros - 1
    out = np.full(len(zeros), FLOOR)
    long = np.flatnonzero(size >= LEAST)
    if not len(long):
        return out
    _, first, back = np.unique(span_hashes(codes, zeros[long] + 1, zeros[long] + 1 + size[long]), return_index=True, return_inverse=True)
    of = long[first]
    n = size[of] + 1  # with the zero before
    total = np.cumsum(n)
    found = np.zeros(len(of))
    i = 0
    while i < len(of):  # some words at a time, as each of their characters begins several triples
        j = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + PART, "right")))
        heads = total[i:j] - n[i:j] - (total[i] - n[i])
        own = np.append(codes[np.arange(n[i:j].sum()) + np.repeat(zeros[of[i:j]] - heads, n[i:j])], np.uint8(0))
        triple, word, weight = weighed(own, np.append(np.repeat(np.arange(j - i), n[i:j]), j - i))
        found[i:j] = np.bincount(word, weight * table[triple], j - i) / np.sqrt(np.maximum(np.bincount(word, weight * weight, j - i), 1e-9))
        i = j
    out[long] = np.clip(found + bias, FLOOR, TOP)[back]
    return out


def _runs(zeros: np.ndarray, size: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of words of 1 to most letters, and for each the end of its run of such words in one row."""
    short = (size >= 1) & (size <= most)
    follow = np.zeros(len(zeros), bool)
    follow[1:] = short[1:] & short[:-1] & (rows[1:] == rows[:-1])
    at = np.flatnonzero(short)
    breaks = np.append(np.flatnonzero(~follow), len(zeros))
    return at, breaks[np.searchsorted(breaks, at, "right")]


def joined(codes: np.ndarray, zeros: np.ndarray, rows: np.ndarray):
    """Codes, zeros and rows, in chunks, of the words of LEAST letters or more that runs of short words give when joined."""
    size = np.append(zeros[1:], len(codes) - 1) - zeros - 1 if len(zeros) else np.zeros(0, int)
    at, stop = _runs(zeros, size, rows, GAPPED)
    heads = np.concatenate([[True], stop[1:] != stop[:-1]]) & (stop - at > JOIN) if len(at) else np.zeros(0, bool)
    spans = [(at[at + k <= stop], at[at + k <= stop] + k) for k in range(2, JOIN + 1)] + [(at[heads], stop[heads])]
    one, end = _runs(zeros, size, rows, 1)
    heads = np.concatenate([[True], end[1:] != end[:-1]]) & (end - one > JOIN) if len(one) else np.zeros(0, bool)
    spans.append((one[heads], end[heads]))
    starts, ends = (np.concatenate([x[k] for x in spans]) for k in (0, 1))
    letter = np.concatenate([[0], np.cumsum(size)])
    keep = letter[ends] - letter[starts] >= LEAST
    starts, ends = starts[keep], ends[keep]
    letters, n = codes[codes > 0], letter[ends] - letter[starts] + 1
    total = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + CHUNK, "right")))
        first = total[i:j] - n[i:j] - (total[i] - n[i])
        step = np.arange(int(n[i:j].sum())) - np.repeat(first, n[i:j])
        out = np.where(step > 0, letters[np.repeat(letter[starts[i:j]], n[i:j]) + np.maximum(step - 1, 0)], 0).astype(np.uint8)
        yield np.append(out, np.uint8(0)), first, rows[starts[i:j]]
        i = j


def vectors(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct triples and normalised weights of each (folded) word."""
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("latin-1"), np.uint8)
    owner = np.cumsum(codes == 0) - 1
    triple, word, weight = weighed(codes, owner)
    weight = weight / np.sqrt(np.bincount(word, weight * weight, len(words)))[word]
    bounds = np.searchsorted(word, np.arange(len(words) + 1))
    return [(triple[i:j], weight[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]


def kernel(words: list[str], dense: np.ndarray) -> np.ndarray:
    """Kernel values with the landmarks whose weights are the columns of dense."""
    out = np.zeros((len(words), dense.shape[1]), np.float32)
    for s in range(0, len(words), 1000):
        found = vectors(words[s : s + 1000])
        t = np.concatenate([x[0] for x in found])
        v = np.concatenate([x[1] for x in found]).astype(np.float32)
        heads = np.cumsum([0] + [len(x[0]) for x in found])[:-1]
        out[s : s + len(found)] = np.add.reduceat(dense[t] * v[:, None], heads, axis=0)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last: bias) of the squared-hinge machine, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(25):
        slack = 1 - y * (x @ w)
        on = slack > 0
        a = x[on] * cost[on, None]
        step = np.linalg.solve(np.diag(reg) + 2 * a.T @ x[on], reg * w - 2 * a.T @ (y[on] * slack[on]))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(codes, zeros, rows, n: int, table, bias) -> np.ndarray:
    """For each text its three highest word margins (equal ones count once) and the logarithm of its number of words."""
    out = np.full((n, 4), FLOOR)
    count = np.bincount(rows, minlength=n)
    out[:, 3] = np.log1p(count)
    value = margins(codes, zeros, table, bias)
    more = [(margins(c, z, table, bias), r) for c, z, r in joined(codes, zeros, rows)]
    if more:
        value, rows = np.concatenate([value, *(m[0] for m in more)]), np.concatenate([rows, *(m[1] for m in more)])
        order = np.argsort(rows, kind="stable")
        value, rows = value[order], rows[order]
    if len(value):
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        for k in range(3):
            most = np.maximum.reduceat(value, heads)
            out[rows[heads], k] = most
            value = np.where(value == np.repeat(most, np.diff(np.append(heads, len(rows)))), FLOOR, value)
    return out


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """The distinct folded words of LEAST letters or more, joined ones too, of each text of a block, in order, and the texts' counts of words."""
    codes, zeros, rows = folded(data, offsets)
    own: list[set[str]] = [set() for _ in offsets[1:]]
    for c, z, at in ((codes, zeros, rows), *joined(codes, zeros, rows)):
        raw = c.tobytes().decode("latin-1")
        ends = np.append(z[1:], len(c) - 1)
        for s, e, r in zip(z.tolist(), ends.tolist(), at.tolist(), strict=True):
            if e - s - 1 >= LEAST:
                own[r].add(raw[s + 1 : e])
    return [sorted(x) for x in own], np.bincount(rows, minlength=len(own))


def _read(batches):
    """Of each text, in a worker: its distinct words, joined by zeros, their number, and its number of words."""
    for part, data, offsets in text_blocks(batches, "text"):
        found, counts = _distinct(data, offsets)
        get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([get("hash"), get("toxic"), pa.array(["\0".join(x).encode("latin-1") for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array(counts, pa.int64())], ["hash", "toxic", "words", "size", "n_words"])


def _groups(word: str) -> np.ndarray:
    """Hashes (under 2^22) of the letter groups of four to six signs of a word and its two ends."""
    w = f"\0{word}\0".encode("latin-1")
    return np.array([zlib.crc32(w[i : i + n]) >> 10 for n in (4, 5, 6) for i in range(len(w) - n + 1)], np.int32)


def trained(samples: list[tuple[str, int]], landmarks: int = LANDMARKS) -> dict | None:
    """The model from (text, label) rows, or None where one label is missing."""
    rows = []
    for text, y in samples:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        found, counts = _distinct(data, np.array([0, len(data)]))
        rows.append(("\0".join(found[0]).encode("latin-1"), int(counts[0]), y))
    return fitted(rows, landmarks)


def fitted(samples: list[tuple[bytes, int, int]], landmarks: int = LANDMARKS, pool_size: int = POOL, hard_size: int = HARD) -> dict | None:
    """The model from (distinct folded words joined by zeros, number of words, label) rows, or None where one label is missing."""
    samples = sorted(samples)
    labels = np.array([y for _, _, y in samples])
    if not 0 < labels.sum() < len(labels):
        return None
    number: dict[str, int] = {}
    of_text = [np.array(sorted(number.setdefault(w, len(number)) for w in x.decode("latin-1").split("\0") if w), np.int32) for x, _, _ in samples]
    words, counts = list(number), np.array([n for _, n, _ in samples])
    del number
    toxic = [x for x, y in zip(of_text, labels, strict=True) if y == 1 and len(x)]
    clean = [x for x, y in zip(of_text, labels, strict=True) if y == 0]
    if not toxic:
        return None
    groups = [_groups(w) for w in words]
    often = np.zeros((2, 1 << 22), np.int32)
    for k, texts in enumerate((clean, toxic)):
        for x in texts:
            if len(x):
                often[k, np.unique(np.concatenate([groups[w] for w in x]))] += 1
    # how far the commonest of a word's letter groups exceed in toxic documents what clean ones make us expect
    expected = (often[0] + 0.5) / (len(clean) + 1) * (len(toxic) + 1)
    excess = ((often[1] - expected) / np.sqrt(expected + 1)).astype(np.float32)
    value = np.array([excess[g].max() for g in groups])
    del often, expected, excess, groups
    in_clean = np.zeros(len(words), bool)
    for x in clean:
        in_clean[x] = True
    pool = sorted(np.flatnonzero(in_clean).tolist(), key=lambda w: hash_of(words[w]))[:pool_size]
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("latin-1"), np.uint8)
    zeros = np.flatnonzero(codes == 0)[:-1]
    score = None
    for _ in range(ROUNDS):
        times: dict[int, int] = {}
        for x in toxic:
            best = value[x].max()
            chosen = x[(value[x] >= max(best * 0.6, 1e-9)) & ~in_clean[x]]
            for w in chosen.tolist() if len(chosen) else [max(x.tolist(), key=lambda w: (value[w], words[w]))]:
                times[w] = times.get(w, 0) + 1
        pos = sorted(times, key=lambda w: words[w])
        hard = [] if score is None else sorted(set(np.flatnonzero(in_clean).tolist()) - set(pos), key=lambda w: (-score[w], words[w]))[:hard_size]
        neg = sorted({*hard, *(w for w in pool if w not in times)}, key=lambda w: words[w])
        chosen = sorted(pos, key=lambda w: (-times[w], words[w]))[: landmarks // 2]
        chosen = [words[w] for w in chosen + (hard or neg)[: landmarks - len(chosen)]]
        dense = np.zeros((1 << 15, len(chosen)), np.float32)
        for k, (t, v) in enumerate(vectors(chosen)):
            np.add.at(dense[:, k], t, v)
        value_k, vector_k = np.linalg.eigh(kernel(chosen, dense).astype(np.float64) + 1e-3 * np.eye(len(chosen)))
        root = vector_k @ np.diag(1 / np.sqrt(np.maximum(value_k, 1e-3))) @ vector_k.T
        x = kernel([words[w] for w in pos + neg], dense) @ root.astype(np.float32)
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        cost = np.concatenate([np.array([times[w] for w in pos], float), np.ones(len(neg))])
        cost[: len(pos)] *= len(neg) / max(cost[: len(pos)].sum(), 1) * 0.5
        w = svm(x, y, cost)
        table, bias = (dense @ (root @ w[:-1]).astype(np.float32)), float(w[-1])
        score = margins(codes, zeros, table, bias)
        value = score + 1
    found = np.full((len(samples), 4), FLOOR)
    found[:, 3] = np.log1p(counts)
    for k, x in enumerate(of_text):
        top = np.unique(np.append(score[x], FLOOR))[::-1][:3]
        found[k, : len(top)] = top
    return {"table": table, "bias": bias, "weights": logistic(found, labels.astype(float)), "landmarks": chosen}


def hash_of(word: str) -> int:
    h = 1469598103934665603
    for c in word.encode("latin-1"):
        h = (h ^ c) * 1099511628211 % (1 << 64)
    return h


def _score(model: dict | None):
    def run(batches):
        for part, data, offsets in text_blocks(batches, "text"):
            n = len(offsets) - 1
            score = np.zeros(n)
            if model:
                x = features(*folded(data, offsets), n, model["table"], model["bias"])
                score = 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))
            get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def sampled(docs: DataFrame, labels: DataFrame, rows: int = ROWS, words: int = WORDS) -> list[tuple[bytes, int, int]]:
    """At most rows different texts of each label, those of the lowest text hash, from docs (doc_id, text) and labels (doc_id, toxic), as fitted() takes them.

    Only ids and hashes meet the labels, and copies fall together before the lowest of each label are
    taken. The texts of the rows chosen (at most twice rows) are fetched by a broadcast of their ids and
    read whole in the workers; the driver gets the words of as many rows of a label, by hash, as have
    words distinct words in all, and of the first always.
    """
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", F.xxhash64(text).alias("h")).join(labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id")
    texts = keys.groupBy(F.col("h").alias("hash"), "toxic").agg(F.min("doc_id").alias("id"))
    chosen = [texts.where(F.col("toxic") == y).orderBy("hash").limit(rows) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    met = docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.xxhash64(text) == F.col("hash")))
    read = stored(met.select("hash", "toxic", "text").mapInArrow(_read, "hash long, toxic int, words binary, size long, n_words long"), "toxicity-words")
    sizes = read.groupBy("hash", "toxic").agg(F.max("size").alias("size")).collect()
    last = {}
    for y in (0, 1):
        total = 0
        for k, r in enumerate(sorted((r for r in sizes if r.toxic == y), key=lambda r: r.hash)):
            total += r.size
            if k and total > words:
                break
            last[y] = r.hash
    few = [read.where((F.col("toxic") == y) & (F.col("hash") <= h)) for y, h in last.items()]
    found = [(bytes(r.words), r.n_words, r.toxic) for part in few for r in part.dropDuplicates(["hash", "toxic"]).collect()]
    discard(read)
    return found


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows (doc_id, held_out, text)."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = remainder("doc_id", 5) == 0
    return scored(docs.select("doc_id", out.alias("held_out"), "text"), fitted(sampled(docs.where(~out).select("doc_id", "text"), labels)))
