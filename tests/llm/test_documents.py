"""Operators over documents: odd rows, empty tables, brute force, SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, jaccard_join, language_id, lm_score, packing, quality_rules, suffix_dedup, toxicity
from tesserae.llm.common import remainder, span_hashes
from tesserae.llm.components import components
from tesserae.llm.suffix_array import Intervals, common_prefixes, suffix_array

from .helpers import DOCS, SF, odd_documents, same


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0).cache()


def test_queries_equal_sql(spark):
    for module in (quality_rules, jaccard_join, lm_score):
        assert same(module.query(spark, SF), module.SQL), module.__name__


def test_quality_rules(spark, odd, none):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.verdicts(odd).collect()}
    assert sum(1 for _ in quality_rules.verdicts(odd).collect()) == 10 and quality_rules.verdicts(none).count() == 0
    assert got[2, 0].base_failed and got[3, 0].base_failed and not got[2, 0].kept and got[1, 11].kept
    lines = [(i, f"shared line of some words here\nown {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "h", 1) for i in range(25)]
    only = [(100 + i, "shared line of some words here\nshared line of some words here\n12 a b c", "en", "h", 1) for i in range(3)]
    docs = spark.createDataFrame(lines + only, DOCS)
    kept = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    assert all(kept[i].kept for i in range(25)) and not any(kept[100 + i].kept for i in range(3))
    assert kept[0].words_left == kept[0].n_words and kept[1].words_left == kept[1].n_words - 6
    cleaned = {r.doc_id: r for r in quality_rules.cleaned(docs).collect()}
    assert set(cleaned) == set(range(25)) and cleaned[1].text.startswith("own 1 ") and cleaned[0].text == lines[0][1] and cleaned[1].n_chars == len(cleaned[1].text)


def brute_jaccard(rows):
    def grams(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    return [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) * 5 >= len(a | b) * 4] for i, a in enumerate(sets)]


@pytest.mark.parametrize(("block", "few"), [(256, 1 << 20), (3, 0)])
def test_jaccard_join_against_all_pairs(spark, block, few):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 14)):
            words = [f"e{rng.randint(0, 99)}" if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.joined(docs, block, few).collect()}
    links = brute_jaccard(rows)
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    assert [got[i].n_links for i in range(len(rows))] == [len(x) for x in links]
    assert [got[i].class_id for i in range(len(rows))] == label


def test_jaccard_odd_rows(odd, none):
    got = jaccard_join.joined(odd).collect()
    assert len(got) == 10 and [r.n_links for r in got if r.doc_id == 4] == [1, 1] and jaccard_join.joined(none).count() == 0
    assert all(r.class_id == r.doc_id and r.first for r in got if r.n_grams == 0)
    thin = jaccard_join.thinned(odd)
    assert thin.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and thin.count() == 9 and jaccard_join.thinned(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(31), 0) | dict.fromkeys((100, 101, 102), 100)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    from tesserae.llm import components as module

    tables, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda frame, tag: tables.append(tag) or real(frame, tag))
    chain = spark.range(999).selectExpr("id as a", "id + 1 as b").union(spark.range(200).selectExpr("5000L as a", "5001 + id as b"))
    got = {r.node: r.label for r in components(chain).collect()}
    assert got == dict.fromkeys(range(1000), 0) | dict.fromkeys(range(5000, 5201), 5000)
    assert tables.count("edges") <= 3 and tables.count("up") <= 15


def test_hot_keys_meet_the_same_rows(spark):
    from tesserae.llm.common import met_by

    left = spark.range(6000).selectExpr("if(id % 3 > 0, 7, id) as key", "id")
    right = left.groupBy("key").count()
    got = met_by(left, right, "key", "count", 6000)
    assert got.count() == 6000 and got.where("count = 4000").count() == 4000 and "Broadcast" in got._jdf.queryExecution().toString()
    hot = spark.range(30000).selectExpr("if(id % 3 > 0, 7, id) as key", "id")
    assert met_by(hot, hot.groupBy("key").count(), "key", "count", 30000).where("count = 20000").count() == 20000


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(0, 60))]
        order = suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        common = lambda i, j: next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]), 0 if i != j else len(s) - i)  # noqa: B023, E731
        assert common_prefixes(s, order) == ([0] if s else []) + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
        for i in range(len(s)):
            for m in (1, 2, 4):
                if i + m <= len(s):
                    like = [k for k, j in enumerate(order) if s[j : j + m] == s[i : i + m]]
                    at, others = Intervals(s).of(np.array([i]), np.array([m]))
                    assert at[0] == like[0] and others[0] == (len(like) > 1)


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    where = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = set()
        for i in range(len(d) - length + 1):
            if where[d[i : i + length]] > 1:
                gone.update(range(i, i + length))
        left = bytes(c for i, c in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(left).hexdigest()))
    return out


def repeating_texts():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(300)) for _ in range(4)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 50) : rng.randint(150, 300)] for _ in range(rng.randint(1, 4))) for _ in range(50)]
    return texts + ["a" * 500, None, "", "xy" * 300, texts[3], "short", base[0][:61] + "|" + base[0][:60]]


@pytest.mark.parametrize(("block", "length", "short", "piece"), [(1 << 20, 60, None, 1 << 22), (150, 60, 41, 1 << 22), (1 << 20, 100, 60, 90), (1 << 20, 24, 24, 50)])
def test_suffix_dedup_against_all_windows(spark, block, length, short, piece):
    texts = repeating_texts() + ["a" * 2500 + "b" * 2300, "a" * 1700 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60)
    found = suffix_dedup.deduplicated(docs, length, block, short, piece).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)
    repeated = {r.doc_id: r.n_repeated for r in found}
    assert [repeated[i] for i in range(len(texts))] == [x[1] for x in brute_repeats(texts, short or length)]


def test_repeats_come_from_the_suffix_array(monkeypatch):
    bodies = [t.encode() for t in repeating_texts() if t and len(t.encode()) >= 60]
    counts = [len(b) - 59 for b in bodies]
    where = Counter(b[i : i + 60] for b in bodies for i in range(len(b) - 59))
    runs = lambda groups: {(b, s + k) for b, _, s, n in suffix_dedup.repeats(bodies, counts, groups, 60) for k in range(n)}
    assert runs([0] * len(bodies)) == {(b, i) for b, body in enumerate(bodies) for i in range(len(body) - 59) if where[body[i : i + 60]] > 1}
    alone = {(b, i) for b, body in enumerate(bodies) for i in range(len(body) - 59) if sum(body[j : j + 60] == body[i : i + 60] for j in range(len(body) - 59)) > 1}
    assert runs(list(range(len(bodies)))) == alone
    monkeypatch.setattr(suffix_dedup.Intervals, "of", lambda self, starts, symbols: (starts, starts < 0))
    assert runs([0] * len(bodies)) == set()


def test_suffix_dedup_query_and_odd_rows(spark, odd, none):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, SF).collect()}
    assert [got[r.doc_id] for r in rows] == brute_repeats([r.text for r in rows], 400)
    assert suffix_dedup.deduplicated(none).count() == 0 and suffix_dedup.cleaned(none).count() == 0
    kept = suffix_dedup.cleaned(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "None", "5", "6", "None"])  # the long text twice and the periodic one go


def test_toxicity_kernel_against_enumerated_subsequences():
    def counted(word):
        full, out = f"\0{word}\0", Counter()
        for i in range(len(full)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(full) - 1) + 1):
                for j in range(i + 1, k):
                    out[full[i] + full[j] + full[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    rng = random.Random(8)
    words = ["banana", "bandana", "aaaaaa", "abc", "abcabcabcabc", *("".join(rng.choice("abcd") for _ in range(rng.randint(3, 14))) for _ in range(40))]
    code = lambda w: "".join(chr(ord(c) - 96) for c in w)
    dense = np.zeros((1 << 15, len(words)), np.float32)
    for k, (t, v) in enumerate(toxicity.vectors([code(w) for w in words])):
        dense[t, k] = v
    got = toxicity.kernel([code(w) for w in words], dense)
    bags = [counted(w) for w in words]
    dot = lambda a, b: sum(n * b[t] for t, n in a.items())
    want = np.array([[dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 for b in bags] for a in bags])
    assert np.allclose(got, want, atol=1e-5) and np.allclose(np.diag(got), 1, atol=1e-5) and abs(want[0, 1] - 0.720) < 0.01
    data = (" ".join(words) + " ab banana").encode()
    codes, zeros, _ = toxicity.folded(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    value = toxicity.margins(codes, zeros, dense[:, 0], 0.0)
    assert np.allclose(value[: len(words)], want[:, 0], atol=1e-5) and value[-2] == toxicity.FLOOR and abs(value[-1] - 1) < 1e-5


def test_toxicity_folds_letters_of_all_planes():
    text = "\U0001d4be\U0001d4b9\U0001d4be\U0001d45c\U0001d4c9 \U00020000\U00020001\U00020002 ıdïöt"
    data = text.encode()
    codes, zeros, _ = toxicity.folded(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    words = bytes(codes).strip(b"\0").split(b"\0")
    assert words[0] == bytes(ord(c) - 96 for c in "idiot") and len(words[1]) == 3 and min(words[1]) >= 27 and words[2][1:] == words[0][1:]


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "Alice has 12 apples and gives 5 apples to Bob, so how many apples does Alice have now in total?"), (2, "too short item"), (3, None), (None, "")], "item_id long, text string")
    texts = ["Intro. Carol has 40 apples and gives 7 apples to Dave, so how many apples does Carol have now in total? Yes", "alice HAS 12 apples and gives 5 apples to bob, so how many apples does alice have now in total?", "this is a too short item of text", "Carol has 40 apples", None, "Eve has 4 apples and gives 5 pears"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    for bound in (1 << 21, 0):  # by hash table and by join
        got = {r.doc_id: r.item_ids for r in decontaminate.checked(docs, items, bound).collect()}
        assert got == {0: [1], 1: [1], 2: [2], 3: [], 4: [], 5: []}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5]
    assert decontaminate.checked(odd, items).count() == 10 and decontaminate.checked(none, items).count() == 0
    assert decontaminate.checked(odd, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_finds_every_item_in_the_tables(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {d.doc_id for d in docs if any(i.text in (d.text or "") for i in items)}
    got = {r.doc_id for r in decontaminate.query(spark, SF).where("contaminated").collect()}
    assert held and held <= got and len(got) <= len(held) + 2


def one_by_one(items, opened):
    bins = []
    for n in sorted(items, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            min(fit, key=lambda b: b[0] - b[1])[1] += n
        else:
            bins.append([opened(n, 0), n])
    return sorted(c - u for c, u in bins)


def test_packing_by_counts_equals_packing_one_by_one():
    rng = random.Random(1)
    for _ in range(50):
        items = [rng.randint(1, 40) for _ in range(rng.randint(1, 200))]
        plan, counts, rule = packing.Plan((16, 32, 40)), Counter(items), lambda n, _: next(c for c in (32, 40) if c >= n)
        for n in sorted(counts, reverse=True):
            plan.place(n, counts[n], rule)
        assert sorted(r for r, g in plan.open.items() for a, b, _ in g for _ in range(b - a)) == one_by_one(items, rule)
        best = packing.planned(counts, (16, 32, 40))
        assert best.cost() <= min(sum((next(x for x in (16, 32, 40) if x >= used) + 16) * (b - a) for a, b, used, _ in plan.bins()), best.cost())


def test_packing_holds_every_token_once(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame, part in ((docs, packing.PART), (docs, 5), (odd, 2)):
        rows = packing.packed(frame, (64, 128, 256), part=part).collect()
        by_bin = {}
        for r in rows:
            by_bin.setdefault(r.bin_id, []).append(r)
        assert sorted(by_bin) == list(range(len(by_bin)))
        for b in by_bin.values():
            end = 0
            for r in sorted(b, key=lambda r: r.bin_offset):
                assert r.bin_offset == end
                end += r.n_tokens
            assert b[0].bin_capacity == next(c for c in (64, 128, 256) if c >= end)
        assert sum(r.n_tokens for r in rows) == sum(len((r.text or "").split()) + 1 for r in frame.collect())
    assert packing.packed(none).count() == 0


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = language_id.query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in got)
    samples = {"en": ["the cat sat on the mat and the dog"], "fr": ["le chat est sur la table et le chien"]}
    rows = odd.withColumn("held_out", remainder("doc_id", 4).eqNullSafe(2)).withColumn("lang_pred", F.lit("x"))
    found = language_id.predicted(rows, samples).collect()
    assert len(found) == 10 and all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (2, 3, 5, 6)) and language_id.predicted(none.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text"), samples).count() == 0
    assert {r.lang_pred for r in language_id.predicted(rows, {}).collect()} == {"und"}


def plain_phrases(data: list, sample: list) -> int:
    data, sample = "".join(map(chr, data)), "".join(map(chr, sample))
    at, n = 0, 0
    while at < len(data):
        size = 1
        while at + size <= len(data) and data[at : at + size] in sample:
            size += 1
        at += max(size - 1, 1)
        n += 1
    return n


@pytest.mark.parametrize("segment", [512, 7, 1])
def test_phrases_equal_plain_parsing(segment):
    rng = random.Random(2)
    samples = {"a": ["abcabcabd xyz"], "b": ["zzz yyx ab"], "c": ["".join(rng.choice("abc\U00020000\u4e2d ") for _ in range(300))]}
    model = language_id.Automata(samples)
    texts = ["".join(rng.choice("abcdxyz q\U00020000\u4e2d") for _ in range(rng.choice([1, 30, 60, 3000]))) for _ in range(12)] + ["ab" * 900, samples["c"][0] * 9]
    coded = [model.folded(model._points(t)) for t in texts]
    size = np.array([len(c) for c in coded])
    heads = np.cumsum(size) - size
    each = -(-size // segment)
    row = np.repeat(np.arange(len(size)), each)
    step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    starts = heads[row] + step * segment
    got = model.phrases(np.concatenate(coded), starts, np.minimum((heads + size)[row] - starts, segment), step > 0)
    for k, name in enumerate(model.names):
        sample = model.folded(model._points("\n".join(samples[name]))).tolist()
        assert np.bincount(row, got[k], len(texts)).tolist() == [plain_phrases(c.tolist(), sample) for c in coded]


def test_language_id_knows_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(1, True, "\U00020000\U00020001"), (2, True, "abc")], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predicted(docs, {"zh": ["\U00020000\U00020001\U00020002"], "en": ["abc abd"]}).collect()}
    assert got == {1: "zh", 2: "en"}


def test_lm_score(spark, odd, none):
    rows = lambda f: f.withColumn("held_out", remainder("doc_id", 10) == 0).withColumn("n_tokens", F.lit("x"))
    got = lm_score.scored(rows(odd), lm_score.train(odd)).collect()
    assert len(got) == 10 and all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 5)) and all(r.score <= 0 for r in got)
    assert {r.score for r in lm_score.scored(rows(odd), lm_score.train(none)).collect()} == {0.0}
    assert lm_score.scored(rows(none), lm_score.train(odd)).count() == 0


def contract_of_lm_score(rows):
    """held_out, n_tokens, n_known, train_tokens and base_score of each (doc_id, text), by the words themselves."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper)), None] for _, t in rows]
    out = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for t, o in zip(tokens, out, strict=True) if not o for w in t)
    n, base = counts.total(), counts.total() + 0.1 * (len(counts) + 1)
    return [(o, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.1) / base) for w in t)) for t, o in zip(tokens, out, strict=True)]


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_lm_score_tells_words_of_one_hash_apart(spark, tmp_path, kind):
    one, other = "a", "b"
    for _ in range(10):  # no polynomial modulo 2^64 tells these two from each other
        one, other = one + other, other + one
    data = np.frombuffer(f"{one}{other}".encode(), np.uint8)
    assert len(set(span_hashes(data, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    pairs = [f"{one} x", f"{other} {one.upper()} y", f"{'p' * 100}{one}", f"{'p' * 100}{other} x {other}{one}", f"{one}{other} \x00 \x85\u00a0É é \x1c", None, "", " \n", "x Y"]
    rows = [(i, pairs[i % len(pairs)]) for i in range(1, 61)]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows.append((held, f"{other}{other} {one}{one} q" + other))  # the training texts have no such words, but one of the hash of the first two
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = dict(zip([i for i, _ in rows], contract_of_lm_score(rows), strict=True))
    found = lm_score.query(spark, str(tmp_path))
    assert dict(found.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
    got = {int(r.doc_id): r for r in found.collect()}
    assert {i: tuple(r)[1:5] for i, r in got.items()} == {i: w[:4] for i, w in want.items()}
    assert all(abs(got[i].base_score - w[4]) <= 0.0000501 for i, w in want.items())  # the query rounds as its SQL does
    exact = docs.withColumn("held_out", remainder("doc_id", 10) == 0)
    for r in lm_score.scored(exact, lm_score.train(exact.where("not held_out"))).collect():
        assert math.isclose(r.base_score, want[int(r.doc_id)][4], rel_tol=1e-12)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(map(str, r)) for r in got.values()) == sorted(tuple(map(str, r)) for r in db.execute(lm_score.SQL).fetchall())


def test_toxicity(spark, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    got = toxicity.query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    out = [r for r in got if r.held_out]
    toxic, clean = [r.score for r in out if r.toxic == 1], [r.score for r in out if r.toxic == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) >= 0.95 * len(toxic) * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    words = "table chair window garden river mountain letter number paper winter summer yellow".split()
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(200)]
    samples = [(t, 0) for t in texts[:150]] + [(t + " " + rng.choice(["stupidhead", "wretchling", "stupidface"]), 1) for t in texts[150:]]
    model = toxicity.trained(samples)
    rows = spark.createDataFrame([(1, "garden stupidhead river"), (2, "river wretchXling winter"), (3, "garden river winter table"), (4, "s-t-u-p-i-d-h-e-a-d garden"), (5, None)], "doc_id long, text string").selectExpr("*", "false held_out")
    found = {r.doc_id: r.predicted for r in toxicity.scored(rows, model).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    plain = odd.selectExpr("doc_id", "text", "true held_out").distinct()
    assert toxicity.scored(plain, model).count() == plain.count() and toxicity.trained([("a", 0)]) is None and toxicity.scored(plain.limit(0), model).count() == 0
    assert {r.score for r in toxicity.scored(plain, None).collect()} == {0.0}


def test_toxicity_sample_is_of_different_texts(spark):
    rows = [(i, "one and the same text") for i in range(50)] + [(100 + i, "text of its own " + "ab" * (i + 2)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k in (0, 1) for i, _ in rows], "doc_id long, toxic int")
    for bound, found in ((21, 21), (10, 10)):
        got = toxicity.sampled(docs, labels, bound)
        assert len(got) == len(set(got)) == 2 * found and {r[-1] for r in got} == {0, 1}


def test_toxicity_learns_from_whole_texts(spark):
    words = "table chair window garden river mountain letter number paper winter summer yellow".split()
    rng = random.Random(3)
    texts = [" ".join(rng.choices(words, k=4000)) + (f" wretchling {i}" if i % 2 else f" {i}") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fitted(toxicity.sampled(docs, labels))
    rows = docs.where("doc_id < 10").selectExpr("doc_id", "text", "false held_out")
    assert {r.doc_id: r.predicted for r in toxicity.scored(rows, model).collect()} == {i: i % 2 for i in range(10)}
    assert [len(toxicity.sampled(docs, labels, words=n)) for n in (0, 70)] == [2, 10]


def test_toxicity_joins_gapped_words(spark):
    words = "table chair window garden river mountain to of is in a at letter number paper winter it summer by yellow".split()
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=14)) for _ in range(200)]
    model = toxicity.trained([(t, 0) for t in texts[:150]] + [(t + " " + rng.choice(["stupidhead", "wretchling", "stupidface"]), 1) for t in texts[150:]])
    odd = ["garden is s t u p i d h e a d at river", "garden it is wr et ch li ng in winter", "a table is in it at a river by it", "st up id he ad", "a b", "x"]
    rows = spark.createDataFrame([(i, t, False) for i, t in enumerate(odd)], "doc_id long, text string, held_out boolean")
    assert [r.predicted for r in toxicity.scored(rows, model).orderBy("doc_id").collect()] == [1, 1, 0, 1, 0, 0]
    data = "ab c dxyz ef g".encode()
    found, counts = toxicity._distinct(__import__("numpy").frombuffer(data, "u1"), [0, 6, len(data)])
    spell = lambda w: "".join(chr(96 + ord(c)) for c in w)
    assert [[spell(w) for w in x] for x in found] == [["abc", "abcd"], ["efg", "xyz"]] and counts.tolist() == [3, 3]


def test_language_sample_is_of_different_texts_and_spread(spark):
    header = "gemeinsame kopfzeile aller texte " * 20
    texts = [header + f"ende{chr(97 + i)}" for i in range(8)]
    docs = spark.createDataFrame([("de", texts[0])] * 200 + [("de", t) for t in texts] + [("fr", "court")] + [(None, "x"), ("fr", None)], "lang string, text string")
    whole = language_id.sampled(docs, 5)
    assert len(whole["de"]) == len(set(whole["de"])) == 5 and set(whole["de"]) <= set(texts) and whole["fr"] == ["court"]
    spread = language_id.sampled(docs, 8, 8 * 360)["de"]
    assert len(spread) == 24 and all(len(x) == 120 for x in spread) and {x[-5:] for x in spread[2::3]} == {t[-5:] for t in texts}


def test_every_letter_of_the_samples_has_its_own_code():
    import numpy as np

    letters = [chr(0x4E00 + i) for i in range(400)]
    rng = random.Random(5)
    text = "".join(rng.choice(letters) for _ in range(600))
    samples = {"a": [text], "b": [text[::-1]]}
    model = language_id.Automata(samples)
    assert len({int(model.code[ord(c)]) for c in text}) == len(set(text)) > language_id.CODES
    for part in (text[100:300], text[300:100:-1], "".join(rng.choice(letters) for _ in range(200)) + "xyz"):
        codes = model.folded(model._points(part))
        got = model.phrases(codes, np.array([0]), np.array([len(codes)]), np.array([False]))[:, 0].tolist()
        plain = []
        for name in model.names:
            at, n = 0, 0
            while at < len(part):
                size = 1
                while at + size <= len(part) and part[at : at + size] in samples[name][0]:
                    size += 1
                at += max(size - 1, 1)
                n += 1
            plain.append(n)
        assert all(abs(g - n) <= 1 + sum(c not in text for c in part) for g, n in zip(got, plain, strict=True))


def test_decontamination_of_numbers_names_of_more_words_and_long_runs(spark):
    rng = random.Random(6)
    own = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(i) for i in range(60)).translate(str.maketrans("0123456789", "qrstuvwxyz")) for _ in range(2)]
    items = [
        (1, "Compute 48 / 2 + 17 * 3 - 9 and 55 - 12"),
        (2, "if Alice buys 12 apples and Bob sells 30 pears, how many apples will Alice hold when Bob has gone home with 30 pears?"),
        (3, own[0]),
        (4, "what is 48 2 17"),
    ]
    texts = [
        "Task: compute 48 / 2 + 17 * 3 - 9 and 55 - 12 now",
        "if Mary Ann buys twenty five apples and Jean Paul Smith sells one hundred ten pears, how many apples will Mary Ann hold when Jean Paul Smith has gone home with one hundred ten pears?",
        f"before {' '.join(own[0].split()[20:33])} after",
        f"before {' '.join(own[0].split()[20:32])} after",
        "Compute 50 / 3 + 18 * 4 - 8 and 54 - 13",
        "tell me what is 99 of it",
        "well, what is 48 2 17 then",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 21, 0):
        got = {r.doc_id: r.item_ids for r in decontaminate.checked(docs, frame, bound).collect()}
        assert got == {0: [1], 1: [2], 2: [3], 3: [], 4: [], 5: [], 6: [4]}
