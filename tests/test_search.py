import random
import sqlite3

import pytest

from tesserae.operators import index, snippet
from tesserae.plans import search
from tesserae.plans.query import parse

WORDS = "alpha beta alphabet gamma gam delta epsilon beta-max Café über x1 quick. brown: fox".split()
CASES = [("al", '"al" *'), ("alpha ga", '"alpha" * AND "ga" *'), ('"alpha beta"', '"alpha beta"'), ("beta-m", '"beta-m" *'), ("alpha -gamma", '("alpha" *) NOT "gamma" *'), ('"brown fox" caf', '"brown fox" AND "caf" *')]


@pytest.fixture(scope="module")
def both(spark):
    random.seed(11)
    pick = lambda n: " ".join(random.choices(WORDS, k=random.randint(0, n)))
    rows = [(i << 20, i, 0, pick(2), pick(1), pick(70), "text") for i in range(1, 40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table c using fts5(name, title, body, tokenize='unicode61 remove_diacritics 2', prefix='1 2 3')")
    db.executemany("insert into c(rowid, name, title, body) values (?, ?, ?, ?)", [(r[0], *r[3:6]) for r in rows])
    chunks = spark.createDataFrame(rows, "rowid long, file_id long, page int, name string, title string, body string, source string").cache()
    posts = index.postings(chunks).cache()
    return search.Index(None, chunks, posts, index.corpus_stats(index.doc_stats(chunks)), None), db, {r[0]: r[5] for r in rows}


@pytest.mark.parametrize("text, match", CASES)
def test_scores_equal_a_full_text_engine(both, text, match):
    tables, db, _ = both
    got = {r.rowid: r.score for r in search.scores(tables, parse(text)).collect()}
    expected = dict(db.execute("select rowid, bm25(c, 8.0, 4.0, 1.0) from c where c match ?", (match,)).fetchall())
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("text, match", CASES)
def test_snippets_equal_a_full_text_engine(both, text, match):
    _, db, bodies = both
    found, _ = search.probes(parse(text))
    for rowid, expected in db.execute("select rowid, snippet(c, 2, char(2), char(3), '…', 24) from c where c match ?", (match,)):
        if " -" not in text:
            assert snippet.snippet(bodies[rowid], found) == expected


def test_nothing_for_negative_or_empty_queries(both):
    tables, _, _ = both
    assert search.scores(tables, parse("-alpha")).count() == 0
    assert search.scores(tables, parse("path:x")).count() == 0
