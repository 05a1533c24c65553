"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, from any position of a new text, the
length of the longest match in the language's sample. A text is parsed from left to right into
such longest phrases; the language that needs the fewest, weighted with the logarithm of its
sample's length over the text's length (an estimate of the cross-entropy in bits), wins.

Texts are folded: lower case, each run of other characters than letters is one blank. A letter that
no sample has is a phrase of its own. All segments of SEGMENT folded characters of a block of
documents step through an automaton's table together; then each goes on from the state in which the
one before ended, until it meets the states that it had when it began afresh. So the phrases are
those of one parse of the whole text.

The sample is bounded: ROWS rows of different texts of a language, those of the lowest text hash, and
CHARS characters in all, shared equally among them. Where a language has fewer texts all are taken.
Texts longer than their share give windows of PIECE characters, spread evenly from their beginning to
their end. Languages are few (their number times CHARS characters must fit in memory).

Every letter of the samples has a code of its own: transitions of the CODES - 1 commonest lie in a
dense table, those of the others in sorted arrays; letters of no sample match nothing.

Defined results: a null text, or one without a letter, is ``und`` with score 0; of equal languages
the first by name wins; rows that repeat give equal results each; without any labelled row every
text is ``und``; an empty table gives an empty result; a null id counts as the empty text for the
fold; other columns, whatever their names, are not read. score: the share of the runner-up's bits in the sum of the two, 0.5 to 1 (1 if there is one
language only).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder, text_blocks

ROWS, CHARS, PIECE, SEGMENT, CODES, LETTERS = 96, 57_600, 120, 1024, 64, 0x32400
_known: dict = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For code points under LETTERS, beyond which there are no letters: the lower-case form, and whether it is a letter."""
    if "classes" not in _known:
        low, letter = np.arange(LETTERS, dtype=np.int32), np.zeros(LETTERS, bool)
        for i in range(LETTERS):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                x = c.lower()
                low[i] = ord(x) if len(x) == 1 else i
        _known["classes"] = low, letter
    return _known["classes"]


class Automata:
    """The alphabet and, for each language, the transition table of its suffix automaton."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        low, letter = _classes()
        every = np.concatenate([np.zeros(0, np.int64)] + [self._points("\n".join(samples[n])) for n in self.names])
        every = low[np.minimum(every, LETTERS - 1)][letter[np.minimum(every, LETTERS - 1)]]
        seen, count = np.unique(every, return_counts=True)
        letters = seen[np.argsort(-count, kind="stable")]
        # 0: blank, 1..: the letters of the samples, the commonest first; all others share the last code
        self.size = len(letters) + 2
        kind = np.min_scalar_type(max(self.size, CODES) - 1)
        self.code = np.full(len(letter), self.size - 1, kind)
        self.code[letters] = np.arange(1, len(letters) + 1, dtype=kind)
        self.code = np.where(letter, self.code[low], 0).astype(kind)
        self.tables, self.bits = [], []
        for n in self.names:
            codes = self.folded(self._points("\n".join(samples[n])))
            self.tables.append(suffix_automaton(codes.tolist(), self.size))
            self.bits.append(np.log2(max(len(codes), 2)))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)

    def folded(self, points: np.ndarray) -> np.ndarray:
        codes = self.code[np.minimum(points, LETTERS - 1)]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        return codes[keep]

    def phrases(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Number of phrases that end in each segment (start, size) for each language. follows: whether a segment goes on the text of the one before."""
        rare = self.size > CODES and len(codes) > 0 and codes.max() >= CODES - 1
        out = np.zeros((len(self.names), len(starts)), np.int64)
        if not len(starts):
            return out
        last = np.append(~follows[1:], True)
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        widths = np.searchsorted(-sizes[order], -np.arange(sizes.max()), "left")
        # the state after each letter of a segment, and the phrases that ended in it by then: by letter, then segment
        after, ended = np.zeros((len(widths), len(starts)), np.int32), np.zeros((len(widths), len(starts)), np.int32)
        for k, (table, keys, places, root) in enumerate(self.tables):

            def step(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """States after one more letter, and the phrases that it ends."""
                if rare:
                    to = table[state * CODES + np.minimum(c, CODES - 1)]
                    if len(keys) and len(at := np.flatnonzero(c >= CODES - 1)):
                        key = state[at].astype(np.int64) * self.size + c[at]
                        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        to[at] = np.where(keys[place] == key, places[place], -1)
                else:
                    to = table[state * CODES + c]
                miss = np.flatnonzero(to < 0)
                more = np.zeros(len(c), np.int32)
                to[miss] = root[c[miss]]
                more[miss] = (state[miss] > 0).astype(np.int32) + (to[miss] == 0)
                return to, more

            # every segment from the root
            state, count = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
            first = starts[order]
            for t, n in enumerate(widths):
                state[:n], more = step(state[:n], codes[first[:n] + t])
                count[:n] += more
                after[t, :n], ended[t, :n] = state[:n], count[:n]
            # those that follow, from where the one before ended, until the states are the same
            from_root, in_all = state[place], count[place]
            begun, final, total = np.zeros(len(starts), np.int32), from_root.copy(), in_all.copy()
            late = np.flatnonzero(follows)
            while len(late := late[final[late - 1] != begun[late]]):
                begun[late] = state = final[late - 1]
                live, count = late, np.zeros(len(late), np.int32)
                t = 0
                while len(live):
                    state, more = step(state, codes[starts[live] + t])
                    count += more
                    met = after[t, place[live]] == state  # from here on the phrases are those of the parse from the root
                    done = ~met & (sizes[live] == t + 1)
                    if met.any() or done.any():
                        of = live[met]
                        final[of], total[of] = from_root[of], count[met] + in_all[of] - ended[t, place[of]]
                        final[live[done]], total[live[done]] = state[done], count[done]
                        go_on = ~met & ~done
                        live, state, count = live[go_on], state[go_on], count[go_on]
                    t += 1
                late = np.unique(np.minimum(late + 1, len(starts) - 1))
                late = late[follows[late]]
            out[k] = total + (last & (final > 0))
        return out


def suffix_automaton(codes: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton; state 0 is the root.

    A flat table, state * CODES + code, -1: none, of the codes under CODES - 1; sorted keys, state * size +
    code, and states of the other ones; and, of each of the size codes, the root's transition or 0.
    """
    step: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    count = sum(map(len, step))
    at = np.repeat(np.arange(len(step), dtype=np.int64), np.fromiter(map(len, step), np.int64, len(step)))
    code = np.fromiter((c for x in step for c in x), np.int64, count)
    to = np.fromiter((t for x in step for t in x.values()), np.int32, count)
    table = np.full(len(step) * CODES, -1, np.int32)
    common = code < CODES - 1
    table[at[common] * CODES + code[common]] = to[common]
    keys, places = at[~common] * size + code[~common], to[~common]
    order = np.argsort(keys)
    root = np.zeros(max(size, CODES), np.int32)
    root[list(step[0])] = list(step[0].values())
    return table, keys[order], places[order], root


def _predict(samples: dict[str, list[str]]):
    key = hash(tuple((n, *t) for n, t in sorted(samples.items())))

    def run(batches):
        if _known.get("key") != key:
            _known["automata"], _known["key"] = Automata(samples), key
        model = _known["automata"]
        for part, data, offsets in text_blocks(batches, "text", 1 << 21):
            n = len(offsets) - 1
            points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            codes = model.code[np.minimum(points, LETTERS - 1)]
            keep = codes > 0
            keep[1:] |= codes[:-1] > 0
            edge = heads[:-1][heads[:-1] < len(codes)]
            keep[edge] = True
            heads = np.concatenate([[0], np.cumsum(keep)])[heads]
            codes = codes[keep]
            letters = np.concatenate([[0], np.cumsum(codes > 0)])[heads]
            size = np.diff(heads)
            each = -(-size // SEGMENT)
            row = np.repeat(np.arange(n), each)
            step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            starts = heads[row] + step * SEGMENT
            counts = model.phrases(codes, starts, np.minimum(heads[row + 1] - starts, SEGMENT), step > 0)
            bits = np.array([np.bincount(row, c, n) * b for c, b in zip(counts, model.bits, strict=True)]).reshape(-1, n) / np.maximum(size, 1)
            none = np.diff(letters) == 0
            if len(model.names):
                best = np.argmin(bits, 0)
                names = np.array(model.names, object)[best]
                if len(model.names) > 1:
                    two = np.partition(bits, 1, 0)
                    score = np.where(two[0] + two[1] > 0, two[1] / np.maximum(two[0] + two[1], 1e-300), 0.5)
                else:
                    score = np.ones(n)
            else:
                names, score, none = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            names[none], score[none] = "und", 0.0
            get = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def sampled(labelled: DataFrame, rows: int = ROWS, chars: int = CHARS) -> dict[str, list[str]]:
    """A bounded sample of the rows (lang, text): different texts of each language by lowest text hash, or windows spread over them.

    Copies fall together by their hashes, before the limit; the texts are fetched by a broadcast of the hashes chosen.
    """
    some = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashes = some.select("lang", F.xxhash64("text").alias("hash")).distinct()
    few = hashes.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("k") <= rows)
    few = few.withColumn("share", F.floor(F.lit(chars) / F.count("*").over(Window.partitionBy("lang"))).cast("int")).withColumnRenamed("lang", "of")
    met = some.join(F.broadcast(few), (F.col("lang") == F.col("of")) & (F.xxhash64("text") == F.col("hash")))
    n, pieces = F.length("text"), F.greatest(F.expr(f"share div {PIECE}").cast("int"), F.lit(2))
    spread = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.col("text").substr((F.floor(i.cast("long") * (n - PIECE) / (pieces - 1)) + 1).cast("int"), F.lit(PIECE)))
    found = met.select("lang", "k", F.when(n <= F.greatest("share", F.lit(2 * PIECE)), F.array("text")).otherwise(spread).alias("pieces")).dropDuplicates(["lang", "k"])
    out: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r.lang, r.k)):
        out.setdefault(r.lang, []).extend(r.pieces)
    return out


def predicted(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of rows (doc_id, held_out, text)."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(samples), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remainder("doc_id", 4) == 2
    return predicted(docs.select("doc_id", out.alias("held_out"), "text"), sampled(docs.where(~out).select("lang", "text")))
